"""How the words of a source differ from those of its language and of the other sources.

Terms are shuffled as fixed-width digests. The string of a term is written once per chunk of a task's texts, and is looked at twice: the smallest and
largest string of every kept digest show whether several terms share it, and the terms that a report names get their text back.

1. Languages and groups (language, source) get numbers by hash, with a seed under which no two share one.
2. A task counts terms in numpy, a chunk of texts at a time, told apart by their bytes: rows (group, digest, occurrences, documents, number of the string), in the
   shared folder. The first row of a string has the string too. A chunk is as large as memory allows, so it is the sum before the shuffle.
3. Counts are dealt by digest and summed by (group, digest); a window over the few groups of a digest gives the counts of its language.
4. Digests of enough documents meet their strings. Where the smallest isn't the largest, the digest is split: its rows are counted again by string.
5. Values of terms are compared with the 200th largest of their group, found from numbers alone; only what reaches it gets its text, which
   breaks ties. Values of pairs of sources come from dense blocks of terms, one pass per block for all pairs.

Everything is exact integer arithmetic. Groups of hot languages or sources are spread: sums are combined map-side, blocks are dealt by term, and the
windows that rank are cut to their limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.names import small, texts
from fleetlens.llm.terms import LETTERS, distinct, flat, named, spans, strings
from fleetlens.plans.shared import stored

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Rows a task holds before they leave as a chunk, bytes of their strings, and cells of a dense block of terms and sources.
CHUNK_ROWS, CHUNK_BYTES, BLOCK_CELLS = 1 << 20, 16 << 20, 1 << 20

_SEEN = "l bigint, g bigint, digest bigint, n bigint, docs bigint, word bigint, term string"


class _Chunk:
    """Counts by (group, term) of the texts of a chunk."""

    def __init__(self) -> None:
        self.groups: dict[tuple[int, int], int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.data: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.terms = self.n_rows = self.n_bytes = 0

    def add(self, groups: list[tuple[int, int]], values: list[bytes], bits: int) -> None:
        of_text = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        for first, n_texts, data, starts, ends, of in spans(values, LETTERS):
            names = named(data, starts, ends, bits)
            number, holder = distinct(data, starts, ends, names)
            n_terms = len(holder)
            pairs, counts = np.unique(of * max(n_terms, 1) + number, return_counts=True)
            group = of_text[first : first + n_texts][pairs // max(n_terms, 1)]
            keys, n, docs = _summed(group * max(n_terms, 1) + pairs % max(n_terms, 1), counts, np.ones(len(pairs), np.int64))
            self.rows.append((keys // max(n_terms, 1), keys % max(n_terms, 1) + self.terms, n, docs))
            lengths = (ends - starts)[holder]
            self.data.append(data[flat(starts[holder], lengths)])
            self.lengths.append(lengths)
            self.names.append(names[holder])
            self.terms += n_terms
            self.n_rows += len(keys)
            self.n_bytes += int(lengths.sum())

    def batches(self, first_word: int) -> Iterator[pa.RecordBatch]:
        """Rows by term and group; a string's number is that of its first row, counted from ``first_word``."""
        if not self.n_rows:
            return
        data, lengths, names = (np.concatenate(part) for part in (self.data, self.lengths, self.names))
        ends = np.cumsum(lengths)
        number, holder = distinct(data, ends - lengths, ends, names)
        group, term, n, docs = (np.concatenate(part) for part in zip(*self.rows))
        keys, n, docs = _summed(number[term] * len(self.groups) + group, n, docs)
        term, group = keys // len(self.groups), keys % len(self.groups)
        langs, groups = (pa.array(list(part), pa.int64()) for part in zip(*self.groups))
        for a in range(0, len(keys), 1 << 15):
            some, by = term[a : a + (1 << 15)], pa.array(group[a : a + (1 << 15)])
            shown = np.append(a == 0 or some[0] != term[a - 1], some[1:] != some[:-1])
            held = holder[some[shown]]
            texts_at = np.where(shown, np.cumsum(shown) - 1, -1)
            found = strings(data, (ends - lengths)[held], ends[held]).take(pa.array(texts_at, pa.int64(), mask=texts_at < 0))
            columns = [langs.take(by), groups.take(by), pa.array(names[holder[some]].view(np.int64)), pa.array(n[a : a + (1 << 15)])]
            columns += [pa.array(docs[a : a + (1 << 15)]), pa.array(some + first_word), found.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["l", "g", "digest", "n", "docs", "word", "term"])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order, once each, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(new):
        return (keys, *values)
    return (keys[new], *(np.add.reduceat(v[order], new) for v in values))


def _count_terms(batches: Iterator[pa.RecordBatch], bits: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    word, chunk = TaskContext.get().partitionId() << 40, _Chunk()
    for batch in batches:
        for piece in small([batch], 256):
            groups = list(zip(piece.column("l").to_pylist(), piece.column("g").to_pylist()))
            chunk.add(groups, list(texts(piece)), bits)
            if chunk.n_rows >= chunk_rows or chunk.n_bytes >= CHUNK_BYTES:
                yield from chunk.batches(word)
                word, chunk = word + chunk.terms, _Chunk()
    yield from chunk.batches(word)


def _scaled(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for any long."""
    return F.expr(f"1 + cast({SCALE} AS decimal(10)) * cast({count} + 1 AS decimal(19)) div cast({total} + {kept} AS decimal(19))")


_VALUE = "(p - q) * (p - q) div q"


def _pair_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the terms of a block, for all pairs of groups of its language."""
    groups, absent = right.column("g").combine_chunks(), right.column("p").to_numpy()
    n = len(groups)
    total = np.zeros((n, n), np.int64)
    if left.num_rows:
        ids = np.stack([left.column("digest").to_numpy(), left.column("word").to_numpy()])
        order = np.lexsort(ids)
        new = np.append(True, (ids[:, order[1:]] != ids[:, order[:-1]]).any(0))
        term = np.empty(len(order), np.int64)
        term[order] = np.cumsum(new) - 1
        p = np.tile(absent, (int(term.max()) + 1, 1))
        p[term, pc.index_in(left.column("g").combine_chunks(), value_set=groups).to_numpy()] = left.column("p").to_numpy()
        for j in range(n):
            q = p[:, j : j + 1]
            total[:, j] = ((p - q) ** 2 // q).sum(0)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table([groups.take(pa.array(a)), groups.take(pa.array(b)), pa.array(total[a, b])], ["g", "other", "value"])


def _numbered(read: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Every (lang, source) that occurs with the numbers l and g, and the expressions that give them."""
    found = stored(read.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        l, g = F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g")
        counts = found.select("lang", "source", l, g).agg(
            F.count_distinct("lang") == F.count_distinct("l"), F.count(F.lit(1)) == F.count_distinct("g")
        )
        if all(counts.first()):
            return found.select("lang", "source", l, g), l, g
        seed += 1


def source_divergence(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    digest_bits: int = 64,
    chunk_rows: int = CHUNK_ROWS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Columns lang, source, part, item, value, rank: a source against the others of its language, and the terms it uses more than its language.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least ``least_documents`` of its documents. With
    V kept terms and N occurrences of them, a term with count c weighs p = 1 + floor(10^9 (c + 1) / (N + V)) in a source, and q in its language. Part
    ``pair``: item is each other source, value the sum of floor((p - q)^2 / q) over all kept terms, q being the item's, all ranks; 0 if no term is kept. Part ``term``:
    item is each kept term of the source with p > q, ranks up to ``top_terms``. Ranks are by value, then item in UTF-8 order.

    Null languages, sources and texts are empty strings. Every row is a document, whatever its other columns say; those are ignored. A
    language of one source has no pairs. An empty table gives no rows.
    """
    read = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    labelled, l, g = _numbered(read)
    seen = stored(read.select(l, g, "text").mapInArrow(lambda b: _count_terms(b, digest_bits, chunk_rows), _SEEN), "seen-terms")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]

    def kept_of(rows: DataFrame) -> DataFrame:
        """Counts of a term in its groups, with those of its language, if that has it in enough documents."""
        summed = rows.repartition("digest").groupBy("l", "g", "digest", "word").agg(*sums)
        term = Window.partitionBy("l", "digest", "word")
        first = F.row_number().over(term.orderBy("g")) == 1
        known = summed.withColumns({"_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": first})
        return known.where(F.col("_docs") >= least_documents).select("l", "g", "digest", "word", "n", "n_lang", "first")

    whole = F.lit(-1).cast("long").alias("word")
    kept = stored(kept_of(seen.select("l", "g", "digest", whole, "n", "docs")), "kept-terms")
    said = seen.where("term IS NOT NULL").select("digest", "word", "term")
    candidates = kept.where("first").select("digest").distinct()
    named_by = said.join(candidates, "digest").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    named_by = stored(named_by, "term-strings")
    shared = named_by.where("low != high").select("digest")
    labels = named_by.where("low = high").select("digest", whole, F.col("low").alias("item"))
    if not shared.isEmpty():
        one_word = said.join(shared, "digest").select("digest", "word", "term", F.min("word").over(Window.partitionBy("digest", "term")).alias("_word"))
        one_word = stored(one_word, "split-terms")
        rows = seen.join(one_word.select("word", "_word"), "word").withColumn("word", F.col("_word"))
        split = kept_of(rows.select("l", "g", "digest", "word", "n", "docs"))
        kept = stored(kept.join(shared, "digest", "left_anti").select(*split.columns).unionByName(split), "kept-terms")
        labels = labels.unionByName(one_word.where("word = _word").select("digest", "word", F.col("term").alias("item")))

    in_lang = kept.where("first").groupBy("l").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("lang_total"))
    in_group = kept.groupBy("g").agg(F.sum("n").alias("total"))
    groups = labelled.select("l", "g").join(in_group, "g", "left").join(in_lang, "l", "left").na.fill(0, ["total", "terms", "lang_total"])
    sizes = groups.groupBy("l").agg(F.count(F.lit(1)).alias("groups"))
    groups = stored(groups.join(sizes, "l").withColumn("blocks", F.expr(f"1 + terms * groups div {block_cells}")), "group-totals")

    weighed = kept.join(groups.drop("l"), "g").withColumn("p", _scaled("n", "total", "terms"))
    scored = weighed.withColumn("q", _scaled("n_lang", "lang_total", "terms")).where("p > q")
    scored = scored.select("g", "digest", "word", F.expr(_VALUE).alias("value"))
    by_value = Window.partitionBy("g").orderBy(F.col("value").desc())
    top = scored.select("g", "value", F.row_number().over(by_value).alias("_nth")).where(F.col("_nth") <= top_terms)
    least = stored(top.groupBy("g").agg(F.min("value").alias("_least")), "least-values")
    reaching = scored.join(least, "g").where("value >= _least").join(labels, ["digest", "word"])
    by_item = Window.partitionBy("g").orderBy(F.col("value").desc(), F.col("item"))
    ranked = reaching.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top_terms)
    terms = ranked.select("g", F.lit("term").alias("part"), "item", "value", "rank")

    block = F.pmod(F.xxhash64("digest", "word"), F.col("blocks")).alias("block")
    dealt = weighed.select("l", block, "g", "digest", "word", "p").groupBy("l", "block")
    absent_p = F.when(F.col("terms") == 0, 1).otherwise(_scaled("0", "total", "terms"))
    absent = groups.select("l", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "g", absent_p.alias("p"))
    sums_of = dealt.cogroup(absent.groupBy("l", "block")).applyInArrow(_pair_block, "g bigint, other bigint, value bigint")
    others = labelled.select(F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = sums_of.groupBy("g", "other").agg(F.sum("value").alias("value")).join(others, "other")
    pairs = pairs.withColumn("rank", F.row_number().over(by_item)).select("g", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms).join(labelled, "g").select("lang", "source", "part", "item", "value", "rank")
