"""The best documents for each query by summed term impacts, found over range-maximum tables.

1. Queries are taken in blocks of a fixed amount of text; the terms of a block go to the tasks. Documents are dealt to shards of at most 4,096,
   in the order they are read, and a task writes a posting list (places, counts) per shard and query term to the shared folder, and the lengths of the shard's documents.
2. Numbers of documents, their terms, and documents per term are summed over all shards; they fix the weights.
3. A shard's posting lists stand one after the other in one array of impacts, over which a sparse table holds the place of the largest impact of every range
   whose length is a power of two: two reads give the maximum of any range. A list between two documents is such a range, and the sum of the lists' maxima bounds
   what a document in that interval can score.
4. Each query searches a shard best first: of the open intervals those with the highest bounds are split at the document with the largest
   single impact, which is scored in full, until no bound reaches the 20th best score. Nothing else is cut off, so the result is exact.
5. The best of all shards are ranked; the window keeps only each task's best before the shuffle.

A shard's arrays are bounded by its documents and the block's terms, whatever the corpus holds. Names find terms; bytes decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.names import small, texts
from fleetlens.llm.terms import LETTERS_DIGITS, distinct, named, spans
from fleetlens.plans.shared import stored

TOP = 20
#: Query text whose terms go to the tasks at a time, documents and text of a shard, and intervals split at a time.
BLOCK_BYTES, SHARD_DOCUMENTS, SHARD_BYTES, SPLIT_AT_ONCE = 4 << 20, 4096, 32 << 20, 64

_POSTINGS = "shard bigint, term int, ids array<bigint>, places array<int>, counts array<bigint>"
_FOUND = "query bigint, doc_id bigint, score bigint"


def query_terms(text: bytes) -> Counter[bytes]:
    """The terms of one text, with repeats."""
    found: Counter[bytes] = Counter()
    for _, _, data, starts, ends, _ in spans([text], LETTERS_DIGITS):
        found.update(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
    return found


class _Shard:
    """Postings of consecutive documents for the terms of a block of queries."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: list[int | None], values: list[bytes], known: dict[bytes, int], known_names: np.ndarray) -> None:
        before = len(self.ids)
        self.ids.extend(ids)
        self.bytes += sum(map(len, values))
        for first, n_texts, data, starts, ends, of in spans(values, LETTERS_DIGITS):
            self.lengths.append(np.bincount(of, minlength=n_texts))
            names = named(data, starts, ends)
            asked = np.flatnonzero(known_names[np.minimum(np.searchsorted(known_names, names), len(known_names) - 1)] == names)
            starts, ends, of = starts[asked], ends[asked], of[asked]
            number, holder = distinct(data, starts, ends, names[asked])
            term = np.array([known.get(data[starts[i] : ends[i]].tobytes(), -1) for i in holder.tolist()], np.int64)
            places = first + before + of
            keys, counts = np.unique(term[number] * (1 << 32) + places, return_counts=True)
            keys, counts = keys[keys >= 0], counts[keys >= 0]
            self.postings.append((keys >> 32, keys & ((1 << 32) - 1), counts))

    def batch(self, shard: int) -> pa.RecordBatch:
        """One row per term, and one of term -1 with the ids and lengths of the documents."""
        term, place, count = (np.concatenate(part) for part in zip(*self.postings))
        order = np.lexsort((place, term))
        term, place, count = term[order], place[order], count[order]
        new = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        cuts = np.append(new, len(term))
        lengths = np.concatenate(self.lengths)
        n = len(new) + 1
        ids = pa.ListArray.from_arrays(pa.array([0] + [len(self.ids)] * n, pa.int32()), pa.array(self.ids, pa.int64()))
        offsets = pa.array(np.concatenate(([0, 0], cuts[1:])).astype(np.int32) if len(new) else [0, 0], pa.int32())
        places = pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))
        count_offsets = np.concatenate(([0, len(lengths)], len(lengths) + cuts[1:])).astype(np.int32) if len(new) else [0, len(lengths)]
        counts = pa.ListArray.from_arrays(pa.array(count_offsets, pa.int32()), pa.array(np.concatenate((lengths, count))))
        terms = np.concatenate(([-1], term[new])).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(terms), ids, places, counts], ["shard", "term", "ids", "places", "counts"])


def _index(batches: Iterator[pa.RecordBatch], terms: list[bytes], shard_documents: int) -> Iterator[pa.RecordBatch]:
    number, shard = TaskContext.get().partitionId() << 40, _Shard()
    data = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in terms], np.int64)
    ends = np.cumsum(lengths) - 1
    known, known_names = {t: i for i, t in enumerate(terms)}, np.sort(named(data, ends - lengths + 1, ends))
    for batch in batches:
        for piece in small([batch], min(512, shard_documents)):
            ids, values = piece.column("id").to_pylist(), list(texts(piece))
            if shard.ids and (len(shard.ids) + len(ids) > shard_documents or shard.bytes >= SHARD_BYTES):
                yield shard.batch(number)
                number, shard = number + 1, _Shard()
            shard.add(ids, values, known, known_names)
    if shard.ids:
        yield shard.batch(number)


class RangeMaxima:
    """For any range of an array, the place of its largest value, from two ranges of a power of two that cover it."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        levels = [np.arange(len(values), dtype=np.int32)]
        half = 1
        while 2 * half <= min(longest, len(values)):
            last = levels[-1]
            right = np.concatenate((last[half:], last[len(last) - half :]))
            levels.append(np.where(values[right] > values[last], right, last))
            half *= 2
        self.levels = np.stack(levels)
        self.log = np.zeros(longest + 2, np.int64)
        for n in range(2, longest + 2):
            self.log[n] = self.log[n >> 1] + 1

    def places(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each range [start, end); of an empty one some place."""
        level = self.log[np.maximum(end - start, 1)]
        a = self.levels[level, np.minimum(start, len(self.values) - 1)]
        b = self.levels[level, np.maximum(end - (1 << level), 0)]
        return np.where(self.values[b] > self.values[a], b, a)


@dataclass(frozen=True)
class ShardIndex:
    """Posting lists of a shard, list after list: places of documents, impacts, where each list starts."""

    keys: np.ndarray
    places: np.ndarray
    impacts: RangeMaxima
    begin: np.ndarray
    documents: int

    @classmethod
    def of(cls, term: np.ndarray, place: np.ndarray, impact: np.ndarray, terms: int, documents: int) -> ShardIndex:
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order], impact[order]
        begin = np.searchsorted(term, np.arange(terms + 1))
        return cls(term * documents + place, place, RangeMaxima(impact, documents), begin, documents)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int, at_once: int = SPLIT_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the ``top`` with a score above 0."""
        held = (self.begin[terms + 1] > self.begin[terms]) & (weights > 0)
        terms, weights = terms[held], weights[held]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, end = self.begin[terms][None, :], self.begin[terms + 1][None, :]
        bound, split = self._bounds(start, end, weights)
        found, scores, least = [], [], 1
        best = np.zeros(0, np.int64)
        while len(bound):
            first = np.argpartition(bound, len(bound) - at_once)[-at_once:] if len(bound) > at_once else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[first] = False
            a, b, at = start[first], end[first], split[first]
            cut = np.clip(np.searchsorted(self.keys, terms[None, :] * self.documents + at[:, None]), a, b)
            here = np.minimum(cut, len(self.places) - 1)
            hit = (cut < b) & (self.places[here] == at[:, None])
            score = np.where(hit, self.impacts.values[here] * weights, 0).sum(1)
            found.append(at)
            scores.append(score)
            best = np.concatenate((best, score))
            if len(best) >= top:
                best = np.partition(best, len(best) - top)[-top:]
                least = max(least, int(best.min()))
            new_start, new_end = np.concatenate((a, cut + hit)), np.concatenate((cut, b))
            new_bound, new_split = self._bounds(new_start, new_end, weights)
            old, new = rest & (bound >= least), new_bound >= least
            start, end = np.concatenate((start[old], new_start[new])), np.concatenate((end[old], new_end[new]))
            bound, split = np.concatenate((bound[old], new_bound[new])), np.concatenate((split[old], new_split[new]))
        place, score = np.concatenate(found), np.concatenate(scores)
        keep = score >= least
        return place[keep], score[keep]

    def _bounds(self, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval, a row of ranges, the sum of the maxima and the document with the largest one."""
        at = self.impacts.places(start, end)
        most = np.where(end > start, self.impacts.values[at] * weights, 0)
        return most.sum(1), self.places[at[np.arange(len(at)), most.argmax(1)]]


@dataclass(frozen=True)
class _Queries:
    """What the tasks need to know of a block: terms and weights of each query, and the corpus counts."""

    numbers: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_terms: int
    documents: int
    all_terms: int


def _searched(batches: Iterator[pa.RecordBatch], queries: _Queries, top: int) -> Iterator[pa.RecordBatch]:
    """The candidates of all queries in one shard."""
    ids, lengths, term, place, count = [], np.zeros(0, np.int64), [], [], []
    for batch in batches:
        for t, i, p, c in zip(*(batch.column(name) for name in ("term", "ids", "places", "counts"))):
            counts = c.values.to_numpy()
            if t.as_py() < 0:
                ids, lengths = i.as_py(), counts
            else:
                term.append(np.full(len(counts), t.as_py(), np.int64))
                place.append(p.values.to_numpy().astype(np.int64))
                count.append(counts)
    if not term:
        return
    by_id = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)), np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    terms, places, counts = np.concatenate(term), np.concatenate(place), np.concatenate(count)
    norm = 75 + 25 * lengths * queries.documents // max(queries.all_terms, 1)
    impact = SCALE * counts // (1000 * counts + 12 * norm[places])
    index = ShardIndex.of(terms, rank[places], impact, queries.n_terms, len(ids))
    for number, of, weights in zip(queries.numbers, queries.terms, queries.weights):
        at, score = index.search(of, weights, top)
        best = np.lexsort((at, -score))[:top]
        found = [ids[by_id[i]] for i in at[best].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(best), pa.int64()), pa.array(found, pa.int64()), pa.array(score[best])], ["query", "doc_id", "score"])


SCALE = 1_000_000_000


def _search_block(read: DataFrame, block: list[tuple[int, Counter[bytes]]], top: int, shard_documents: int) -> DataFrame | None:
    """Candidates (query, doc_id, score) of a block of queries."""
    terms = sorted({t for _, counts in block for t in counts})
    if not terms:
        return None
    postings = stored(read.mapInArrow(lambda b: _index(b, terms, shard_documents), _POSTINGS), "postings")
    held = F.when(F.col("term") >= 0, F.size("counts").cast("long")).otherwise(F.expr("aggregate(counts, 0L, (n, c) -> n + if(c > 0, 1L, 0L))"))
    found = postings.groupBy("term").agg(F.sum(held).alias("docs"), F.sum(F.expr("aggregate(counts, 0L, (n, c) -> n + c)")).alias("occurrences"))
    counted = {r["term"]: (r["docs"], r["occurrences"]) for r in found.collect()}
    documents, all_terms = counted.get(-1, (0, 0))
    place = {t: i for i, t in enumerate(terms)}
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * counted.get(i, (0, 0))[0] + 1))) for i in range(len(terms))]
    of = [np.array([place[t] for t in counts], np.int64) for _, counts in block]
    weights = [np.array([n * weight[place[t]] for t, n in counts.items()], np.int64) for _, counts in block]
    queries = _Queries([number for number, _ in block], of, weights, len(terms), documents, all_terms)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, queries, top)

    return postings.groupBy("shard").applyInArrow(searched, _FOUND)


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
    shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """The ``top`` documents of each row of ``queries``: item id, rank from 1, document id, score.

    A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. N documents have a term, L are all their terms, n those of
    one document, df the documents with a term, tf its occurrences in the document. Its weight w is floor(1000 ln((2N + 2) / (2 df + 1))), in doubles; m is
    75 + floor(25 n N / L); the score sums w * floor(10^9 tf / (1000 tf + 12 m)) over the terms of the query, repeats included, in whole
    numbers. Documents of score 0 aren't returned; equal scores rank by ascending id, a null id first.

    Null texts have no terms. Rows that repeat an id are documents, or queries, of their own. Other columns are ignored; an empty
    table on either side gives no rows.
    """
    numbered = queries.select(
        F.monotonically_increasing_id().alias("query"),
        F.col(item_column).cast("long").alias("item"),
        F.coalesce(F.col(item_text_column), F.lit("")).alias("text"),
    )
    numbered = stored(numbered, "queries")
    read = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    blocks = -(-(numbered.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes)
    candidates = None
    for block in range(blocks):
        held = numbered.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").toArrow()
        block_queries = [(number, query_terms(text)) for number, text in zip(held.column("query").to_pylist(), texts_of(held))]
        found = _search_block(read, block_queries, top, shard_documents)
        if found is not None:
            candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        candidates = docs.sparkSession.createDataFrame([], _FOUND)
    best_first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = candidates.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    return ranked.join(numbered.select("query", "item"), "query").select(
        F.col("item").alias(item_column), "rank", F.col("doc_id").alias(id_column), "score"
    )


def texts_of(table: pa.Table) -> Iterator[bytes]:
    """The texts of a table, whatever its batches."""
    for batch in table.to_batches():
        yield from texts(batch)
