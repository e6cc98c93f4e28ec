"""Language identification by a small convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter keeps its maximum, and a
softmax layer reads the maxima. It is trained on windows of a bounded sample: at most ``per_language`` documents of each
language, those with the smallest hash of their id, and ``windows`` windows of each, spread over the whole text.

Prediction covers whole texts in batches of windows. As a filter is linear in the embeddings, its value is a sum of
table entries for pairs of bytes; the network is the same, without its matrix products per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.names import small, texts

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
PER_LANGUAGE, WINDOWS = 400, 4

_LETTER = regex.compile(r"\p{L}")
_BATCH = 64


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * embedding, filters)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.weights, self.bias]


def new_network(languages: list[str], seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return Network(
        languages,
        rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        [draw(w * EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(FILTERS * len(WIDTHS), len(languages)),
        np.zeros(len(languages), np.float32),
    )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of a batch of windows and its gradients, in the order of ``parameters``."""
    n, rows = len(x), np.arange(len(x))[:, None]
    embedded = net.embedding[x]
    pooled, best = [], []
    for width, filters, offset in zip(WIDTHS, net.filters, net.offsets):
        columns = np.lib.stride_tricks.sliding_window_view(embedded, width, 1).transpose(0, 1, 3, 2)
        value = columns.reshape(n, -1, width * EMBEDDING) @ filters
        at = value.argmax(1)
        best.append(at)
        pooled.append(np.maximum(np.take_along_axis(value, at[:, None], 1)[:, 0] + offset, 0))
    hidden = np.concatenate(pooled, 1)
    p = softmax(hidden @ net.weights + net.bias)
    loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
    d = p.copy()
    d[np.arange(n), y] -= 1
    d /= n
    d_hidden = (d @ net.weights.T) * (hidden > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_offsets = [], []
    for i, (width, filters, at) in enumerate(zip(WIDTHS, net.filters, best)):
        g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
        codes = x[rows[:, :, None], at[:, :, None] + np.arange(width)]  # n, filters, width
        seen = net.embedding[codes].reshape(n, FILTERS, -1)
        d_filters.append(np.einsum("nfk,nf->kf", seen, g))
        d_offsets.append(g.sum(0))
        back = (g[:, :, None] * filters.T).reshape(-1, EMBEDDING)
        np.add.at(d_embedding, codes.reshape(-1), back)
    return loss, [d_embedding, *d_filters, *d_offsets, hidden.T @ d, d.sum(0)]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 9, batch: int = 256, rate: float = 0.004) -> Network:
    """Adam over shuffled windows; a fifth of them is cut short at random, so that short texts are known too."""
    net, rng = new_network(languages), np.random.default_rng(5)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            x = windows[order[a : a + batch]].copy()
            length = np.where(rng.random(len(x)) < 0.2, rng.integers(24, x.shape[1], len(x)), x.shape[1])
            x[np.arange(x.shape[1]) >= length[:, None]] = 0
            step += 1
            for p, g, (m, v) in zip(net.parameters(), gradients(net, x, labels[order[a : a + batch]])[1], moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """The network with its filters as tables over pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for width, filters in zip(WIDTHS, net.filters):
            parts = [net.embedding @ filters[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(width)]
            pairs = [(i, (parts[i][:, None] + parts[i + 1][None, :]).reshape(-1, FILTERS)) for i in range(0, width - 1, 2)]
            self.tables.append((width, pairs, (width - 1, parts[-1]) if width % 2 else None))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(windows), _BATCH):
            x = windows[a : a + _BATCH]
            pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            pooled = []
            for (width, pairs, odd), offset in zip(self.tables, self.net.offsets):
                n = x.shape[1] - width + 1
                value = None
                for i, table in pairs:
                    part = table[pair[:, i : i + n]]
                    value = part if value is None else np.add(value, part, out=value)
                if odd:
                    value += odd[1][x[:, odd[0] : odd[0] + n]]
                pooled.append(np.maximum(value.max(1) + offset, 0))
            out.append(softmax(np.concatenate(pooled, 1) @ self.net.weights + self.net.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))


def windows_of(text: bytes, size: int = WINDOW_BYTES) -> np.ndarray:
    """All windows of a text, side by side; the last is filled with zero bytes."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


def _sample_windows(batches: Iterator[pa.RecordBatch], windows: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            every = windows_of(text)
            if len(every) > 1:
                every = every[:-1]
            for i in np.unique(np.linspace(0, len(every) - 1, windows).astype(int)):
                out.append((lang, every[i].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "window"])


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> Network | None:
    """A network from rows (d, text, lang), or None without any; sees at most ``per_language`` documents of a language."""
    usable = labelled.where("d IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    ids = usable.groupBy("lang", "d").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("d"), "d"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "d")
    sample = usable.join(chosen, ["lang", "d"]).groupBy("lang", "d").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(lambda b: _sample_windows(b, windows), "lang string, window binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["window"])) for r in rows)
    languages = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
    return train(x, np.array([languages.index(r[0]) for r in rows]), languages)


def predict(values: list[bytes], predictor: Predictor | None) -> tuple[list[str], list[float]]:
    """Language and score of each text, over all its windows."""
    language, score = ["und"] * len(values), [0.0] * len(values)
    held: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        p = predictor.probabilities(np.concatenate(parts))
        begins = np.cumsum([0, *map(len, parts)])
        for i, a, b in zip(held, begins, begins[1:]):
            mean = p[a:b].mean(0)
            language[i], score[i] = predictor.net.languages[int(mean.argmax())], min(1.0, float(mean.max()))
        held.clear()
        parts.clear()

    for i, text in enumerate(values if predictor else []):
        if _LETTER.search(text.decode()):
            held.append(i)
            parts.append(windows_of(text))
            if sum(map(len, parts)) >= 4 * _BATCH:
                flush()
    if held:
        flush()
    return language, score


def _predicted(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    predictor = Predictor(net) if net else None
    for batch in small(batches):
        language, score = predict(list(texts(batch)), predictor)
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(language, pa.string()), pa.array(score, pa.float64())], ["d", "lang_pred", "score"])


def _clear(batches: Iterator[pa.RecordBatch], net: Network | None, text_column: str, least: float) -> Iterator[pa.RecordBatch]:
    predictor = Predictor(net) if net else None
    for batch in small(batches):
        language, score = predict(list(texts(batch, text_column)), predictor)
        yield batch.filter(pa.array([lang != "und" and value >= least for lang, value in zip(language, score)], pa.bool_()))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a document is in the fold that nothing is learnt from; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred and score, the mean probability over the windows of the text.

    Learns from documents outside the held-out fold that have a language. Texts that are null or have no letter are ``und`` with score 0, and so is
    every text if there is nothing to learn from. Rows that repeat an id are predicted one by one; other columns are ignored.
    """
    read = _read(docs, id_column, text_column, lang_column)
    net = learn(read.where(~held_out(F.col("d"), folds)), per_language)
    predicted = read.select("d", "text").mapInArrow(lambda b: _predicted(b, net), "d bigint, lang_pred string, score double")
    return predicted.select(F.col("d").alias(id_column), held_out(F.col("d"), folds).alias("held_out"), "lang_pred", "score")


def _read(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))


def drop_unclear(
    docs: DataFrame, least: float, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """``docs`` without the rows that ``identify`` finds ``und`` or scores below ``least``; all columns stay."""
    net = learn(_read(docs, id_column, text_column, lang_column).where(~held_out(F.col(id_column), folds)), per_language)
    return docs.mapInArrow(lambda b: _clear(b, net, text_column, least), docs.schema)
