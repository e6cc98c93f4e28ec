"""Log-bilinear language model, trained with noise-contrastive estimation, over the counts of a whole corpus.

The model predicts a class from the two words before: one of the ``classes`` most frequent words of the training texts, the
end of a text, or "another word". A context's vector is the sum of position-wise products with its words' vectors, a class's score its bilinear product with
the class vector plus a bias, and a softmax over all classes makes it a probability. "Another word" is shared out
by smoothed counts, so the probabilities of all words the corpus has, and of one unknown, sum to one.

The texts of an input partition are dealt into chunks of ``CHUNK_BYTES``, so what a task holds doesn't grow with its partition. Each chunk counts its words; the counts meet by word, and the totals go back to the chunks
that need them, so a frequent word costs a row per chunk and not per text. Training runs in every task over all its
training texts, from the parameters of the last round; a round's parameters are the mean over tasks, weighted by tokens. Scores are
normalised by matrix products over batches of different contexts, each taken once in a process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.langid import held_out
from fleetlens.llm.names import blocks, signed, small, texts, word_names
from fleetlens.plans.shared import stored

CLASSES, SIZE = 1024, 24
ROUNDS = 2
NOISE, BATCH, RATE = 64, 512, 0.3
TRAIN_TOKENS = 1 << 20
#: Text of a chunk. A chunk's texts and the totals of its words are sorted in one task.
CHUNK_BYTES = 1 << 24
ALPHA = 0.1

#: Class numbers: another word, the end of a text; words follow.
OTHER, END = 0, 1


@dataclass
class Model:
    words: np.ndarray  # names of the class words, sorted
    number: np.ndarray  # their class numbers
    context: np.ndarray  # (classes, size): vectors of words as context
    position: np.ndarray  # (2, size): weights of the two places
    target: np.ndarray  # (classes, size)
    bias: np.ndarray
    noise: np.ndarray  # probability of each class among training tokens

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.position, self.target, self.bias]

    def classes_of(self, names: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, self.number[at], OTHER)

    def vectors(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.context[two] * self.position[0] + self.context[one] * self.position[1]

    def scores(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target after its two classes; ``norms`` keeps the contexts' normalisers."""
        classes = len(self.bias)
        code = two * classes + one
        missing = np.unique(code[np.isnan(norms[code])])
        for a in range(0, len(missing), BATCH):
            at = missing[a : a + BATCH]
            z = self.vectors(at // classes, at % classes) @ self.target.T + self.bias
            top = z.max(1)
            norms[at] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return np.einsum("ij,ij->i", self.vectors(two, one), self.target[target]) + self.bias[target] - norms[code]


def tokens_of(values: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: number of the first, how many, and the text and name of each word, ASCII lower-cased."""
    for first, data, ends in blocks([t.lower() for t in values]):
        starts, _, names = word_names(data)
        yield first, len(ends), np.searchsorted(ends, starts, side="right"), names


def sequences(owner: np.ndarray, cls: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, target, and the two classes before, of every token; each text ends with END and starts after two of them."""
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    target = np.full(len(cls) + n, END, np.int64)
    of = np.repeat(np.arange(n), counts + 1)
    target[np.arange(len(cls)) + owner] = cls
    place = np.arange(len(target)) - np.repeat(ends - counts, counts + 1)
    one = np.where(place > 0, np.append(END, target[:-1]), END)
    two = np.where(place > 1, np.append([END, END], target[:-2])[: len(target)], END)
    return of, target, two, one


def sum_rows(index: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    into[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def train_on(model: Model, squares: list[np.ndarray], two: np.ndarray, one: np.ndarray, target: np.ndarray, seed: int, rate: float = RATE) -> None:
    """One pass of noise-contrastive estimation with AdaGrad over different trigrams, weighted by their number."""
    classes = len(model.bias)
    code, times = np.unique((two * classes + one) * classes + target, return_counts=True)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(code))
    log_noise = np.log(model.noise * NOISE + 1e-30).astype(np.float32)
    for a in range(0, len(order), BATCH):
        at = order[a : a + BATCH]
        weight = times[at].astype(np.float32)
        weight = (weight / weight.sum())[:, None]
        t, c1, c2 = code[at] % classes, code[at] // classes % classes, code[at] // classes**2
        drawn = rng.choice(classes, NOISE, p=model.noise)
        v2, v1 = model.context[c2], model.context[c1]
        q = v2 * model.position[0] + v1 * model.position[1]
        target_vectors, noise_vectors = model.target[t], model.target[drawn]
        data_score = (q * target_vectors).sum(1) + model.bias[t] - log_noise[t]
        noise_score = q @ noise_vectors.T + model.bias[drawn] - log_noise[drawn]
        up = weight / (1 + np.exp(np.clip(data_score, -30, 30)))[:, None]  # (batch, 1)
        down = -weight / (1 + np.exp(np.clip(-noise_score, -30, 30)))  # (batch, noise)
        dq = up * target_vectors + down @ noise_vectors
        grads = [np.zeros_like(p) for p in model.parameters()]
        sum_rows(np.append(c2, c1), np.concatenate((dq * model.position[0], dq * model.position[1])), grads[0])
        grads[1][0], grads[1][1] = (dq * v2).sum(0), (dq * v1).sum(0)
        sum_rows(np.append(t, drawn), np.concatenate((up * q, down.T @ q)), grads[2])
        np.add.at(grads[3], t, up[:, 0])
        np.add.at(grads[3], drawn, down.sum(0))
        for p, g, s in zip(model.parameters(), grads, squares):
            s += g * g
            p += rate * g / np.sqrt(s)


def new_model(words: list[tuple[int, int]], total: int, texts_count: int) -> Model:
    """From the names and counts of the most frequent words, all training tokens and texts."""
    names = np.array([w for w, _ in words], np.int64).view(np.uint64)
    counts = np.array([c for _, c in words], np.float64)
    order = np.argsort(names)
    number = np.arange(len(words)) + 2
    noise = np.concatenate(([max(total - texts_count - counts.sum(), 0) + 1, texts_count + 1], counts))
    noise /= noise.sum()
    rng = np.random.default_rng(17)
    draw = lambda: rng.normal(0, 0.1, (len(noise), SIZE)).astype(np.float32)
    return Model(names[order], number[order], draw(), np.ones((2, SIZE), np.float32), draw(), np.log(noise).astype(np.float32), noise)


def _in_chunks(batches: Iterator[pa.RecordBatch], partition: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows with the number of their chunk; a chunk ends with the text that fills it."""
    partition = TaskContext.get().partitionId() if partition is None else partition
    size = 0  # bytes of the texts before
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        before = size + np.cumsum(lengths) - lengths
        size += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((partition << 32) + before // CHUNK_BYTES)], [*batch.schema.names, "chunk"])


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each chunk with their count among training texts."""
    chunk: int | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        unique, inverse = np.unique(np.concatenate([n for n, _ in held]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in held]), minlength=len(unique)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), chunk, np.int64)), signed(unique), pa.array(total)], ["chunk", "w", "c"])

    for batch in small(batches):
        chunks = batch.column("chunk").to_numpy()
        for own in np.unique(chunks).tolist():
            if own != chunk and held:
                yield summed()
                held = []
            chunk = own
            part = batch.filter(pa.array(chunks == own))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            for first, _, owner, names in tokens_of(list(texts(part))):
                unique, inverse = np.unique(names, return_inverse=True)
                held.append((unique, np.bincount(inverse, weights=train[first + owner], minlength=len(unique))))
    if held:
        yield summed()


def _trained(batches: Iterator[pa.RecordBatch], model: Model, round_number: int) -> Iterator[pa.RecordBatch]:
    """A task's parameters after one pass over its training texts, times its tokens."""
    own = Model(model.words, model.number, *(p.copy() for p in model.parameters()), model.noise)
    squares = [np.full_like(p, 1e-2) for p in own.parameters()]
    codes: list[tuple[np.ndarray, ...]] = []
    held = total = 0

    def train() -> None:
        train_on(own, squares, *(np.concatenate(c) for c in zip(*codes)), seed=round_number)

    for batch in small(batches):
        for _, n, owner, names in tokens_of(list(texts(batch))):
            _, target, two, one = sequences(owner, own.classes_of(names), n)
            codes.append((two, one, target))
            held, total = held + len(target), total + len(target)
            if held >= TRAIN_TOKENS:
                train()
                codes, held = [], 0
    if codes:
        train()
    flat = np.concatenate([p.reshape(-1) for p in own.parameters()]).astype(np.float64) * total
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), total))], ["at", "value", "n"])


def _averaged(model: Model, rows: DataFrame) -> Model:
    """The mean of the tasks' parameters; their number is that of one model."""
    got = rows.groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
    if not got.num_rows:
        return model
    flat = np.zeros(got.num_rows)
    flat[got.column("at").to_numpy()] = got.column("value").to_numpy()
    parts, begin = [], 0
    for p in model.parameters():
        parts.append(flat[begin : begin + p.size].reshape(p.shape).astype(np.float32))
        begin += p.size
    return Model(model.words, model.number, *parts, model.noise)


@dataclass
class Counts:
    """Of the training tokens: all, the ends among them, different ones, and those of words with a class."""

    tokens: int
    ends: int
    vocabulary: int
    classed: int


def _few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words as they are, those with texts in small parts."""
    for batch in batches:
        yield from small([batch]) if pc.any(batch.column("is_text")).as_py() else [batch]


_SCORES = "d bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(batches: Iterator[pa.RecordBatch], model: Model, counts: Counts) -> Iterator[pa.RecordBatch]:
    """Scores of a chunk's texts, which come after the totals of its words."""
    norms = np.full(len(model.bias) ** 2, np.nan, np.float32)
    base_norm = np.log10(counts.tokens + ALPHA * (counts.vocabulary + 1))
    others = max(counts.vocabulary - (counts.ends > 0) - len(model.words), 0)
    other_norm = np.log10(counts.tokens - counts.ends - counts.classed + ALPHA * (others + 1))
    end_base = np.log10(counts.ends + ALPHA) - base_norm
    chunk: int | None = None
    words: list[tuple[np.ndarray, np.ndarray]] = []
    known, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in _few_texts(batches):
        chunks, is_text = batch.column("chunk").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
        for own in np.unique(chunks).tolist():
            if own != chunk:
                chunk, words, known = own, [], np.zeros(0, np.uint64)
            rows = batch.filter(pa.array((chunks == own) & ~is_text))
            if rows.num_rows:
                words.append((rows.column("w").to_numpy().view(np.uint64), rows.column("n").to_numpy()))
            part = batch.filter(pa.array((chunks == own) & is_text))
            if not part.num_rows:
                continue
            if words:
                known, totals = (np.concatenate(x) for x in zip(*words))
                order, words = np.argsort(known), []
                known, totals = known[order], totals[order]
            n_tokens, n_known = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            base, score = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for first, n, owner, names in tokens_of(list(texts(part))):
                at = np.searchsorted(known, names)
                if len(names) and (at.max() >= len(known) or (known[at] != names).any()):
                    raise RuntimeError("a word without its total: the input changed while it was read")
                times = totals[at] if len(names) else np.zeros(0)
                cls = model.classes_of(names)
                of, target, two, one = sequences(owner, cls, n)
                rows = slice(first, first + n)
                n_tokens[rows] = np.bincount(of, minlength=n)
                n_known[rows] = np.bincount(owner[times > 0], minlength=n) + (counts.ends > 0)
                base[rows] = np.bincount(owner, weights=np.log10(times + ALPHA) - base_norm, minlength=n) + end_base
                within = np.where(cls == OTHER, np.log10(times + ALPHA) - other_norm, 0.0)
                score[rows] = np.bincount(owner, weights=within, minlength=n)
                score[rows] += np.bincount(of, weights=model.scores(two, one, target, norms) / np.log(10), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [part.column("d"), part.column("held_out"), *map(pa.array, (n_tokens, n_known, base, score))],
                ["d", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def log_bilinear_scores(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 10, classes: int = CLASSES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (base-10 logarithms).

    Learns from documents outside the held-out fold; a null id is held out. Tokens are words and one end for each text; a null or empty text is its end
    alone. Without training texts the base is that of one unknown token. Rows that repeat an id are texts of their own; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("d"), text.alias("text"))
    read = read.select("d", held_out(F.col("d"), folds).alias("held_out"), "text")
    read = stored(read.mapInArrow(_in_chunks, "d bigint, held_out boolean, text string, chunk bigint"), "texts")
    by_word = Window.partitionBy("w")
    words = read.select("chunk", "held_out", "text").mapInArrow(_chunk_counts, "chunk bigint, w bigint, c bigint")  # a chunk read by two tasks has a word twice
    totals = words.select("chunk", "w", F.sum("c").over(by_word).alias("n"), (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("first"))
    totals = stored(totals, "words")
    distinct = totals.where("first AND n > 0")
    tokens, vocabulary = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = read.where("NOT held_out").count()
    top = [(r["w"], r["n"]) for r in distinct.orderBy(F.desc("n"), "w").limit(classes - 2).collect()]
    counts = Counts(tokens + ends, ends, vocabulary + (ends > 0), sum(n for _, n in top))
    model = new_model(top, counts.tokens, ends)
    for number in range(rounds):
        model = _averaged(model, read.where("NOT held_out").select("text").mapInArrow(_trainer(model, number), "at bigint, value double, n bigint"))
    none = {c: F.lit(None).cast(t) for c, t in (("d", "bigint"), ("held_out", "boolean"), ("text", "string"), ("w", "bigint"), ("n", "bigint"))}
    columns = ["chunk", "is_text", "d", "held_out", "text", "w", "n"]
    rows = read.select("chunk", F.lit(True).alias("is_text"), "d", "held_out", "text", none["w"].alias("w"), none["n"].alias("n"))
    needed = totals.select("chunk", F.lit(False).alias("is_text"), none["d"].alias("d"), none["held_out"].alias("held_out"), none["text"].alias("text"), "w", "n")
    # Ranges, since by hash several chunks meet in one task while others have none.
    together = needed.unionByName(rows.select(columns)).repartitionByRange("chunk").sortWithinPartitions("chunk", "is_text")
    scored = together.mapInArrow(lambda b: _scored(b, model, counts), _SCORES)
    return scored.select(
        F.col("d").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _trainer(model: Model, number: int):
    return lambda batches: _trained(batches, model, number)
