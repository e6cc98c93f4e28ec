"""Near-duplicate groups by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

A text is a weighted set of shingles of five words (all its words, if it has fewer), ASCII lower-cased. A shingle weighs
its count times the mean inverse document frequency of its words. Frequencies are of words, over all
documents, in a table of fixed size that words share by hash: a shingle's own frequency would take most weight
from just those shingles that large groups of copies have in common.

1. Exact copies become one class, a vertex named by its text. Each class gets ``bands * rows`` ICWS samples; the samples of a band make its key.
2. Classes that share a key are candidates. Buckets become star edges, and the components of these edges bound
   who can be linked, without any pairs.
3. Each class is compared with the leader (least class) of its buckets that it shares most of them with, one pair at a time, by weighted Jaccard similarity. The
   members of a leader are dealt by salt. This already joins most of a large group of copies.
4. In components that are still in parts, a search from class to class compares classes of different parts until all links that join them are found. A
   component of over ``block_bytes`` of shingles is dealt in blocks, and each pair of blocks is a task of its own, so no link is lost.
5. The components of the verified links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.names import blocks, combined, mixed, small, texts, word_names
from fleetlens.plans.shared import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
FREQUENCY_BUCKETS = 1 << 16
#: Shingles of a block of classes that are compared with those of another at a time, and members that are compared with their leader.
BLOCK_BYTES, STAR_ROWS = 8 << 20, 1024

# Quantiles of the two Gamma(2, 1) variables and the uniform one of ICWS.
_POINTS, _STEPS = 2048, 1024


def _gamma_quantiles(n: int) -> np.ndarray:
    x = np.linspace(1e-6, 30, 1 << 18)
    return np.interp((np.arange(n) + 0.5) / n, 1 - np.exp(-x) * (1 + x), x)


_GAMMA = np.random.default_rng(7).permutation(_gamma_quantiles(_POINTS)).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_UNIFORM = ((np.arange(_STEPS) + 0.5) / _STEPS).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts hold a word of each bucket; bucket -1 counts the texts."""
    counts, n = np.zeros(buckets, np.int64), 0
    for batch in small(batches):
        values = [t.lower() for t in texts(batch)]
        n += len(values)
        for _, data, ends in blocks(values):
            starts, _, names = word_names(data)
            of = np.searchsorted(ends, starts, side="right")
            pairs = np.unique(of * buckets + (names % np.uint64(buckets)).astype(np.int64))
            counts += np.bincount(pairs % buckets, minlength=buckets)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["bucket", "n"])


def word_idf(texts_only: DataFrame, buckets: int = FREQUENCY_BUCKETS) -> np.ndarray:
    """Inverse document frequency per bucket of words, over all texts: ``buckets`` numbers at any size.

    1 + ln(N / df) / ln(N), between 1 and 2: a rare word weighs up to twice a word of every text. So a weighted similarity stays
    close to the share of common shingles, and a changed word that happens to be rare doesn't part two copies.
    """
    counted = texts_only.mapInArrow(lambda b: _frequencies(b, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = {row["bucket"]: row["n"] for row in counted.collect()}
    found = np.array([table.get(i, 0) for i in range(buckets)])
    n = max(table.get(-1, 0), 2)
    return (1 + np.log(n / np.clip(found, 1, n)) / np.log(n)).astype(np.float32)


def _weighted(values: list[bytes], idf: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: number of the first, text of each shingle, shingle names, weights; sorted by text and name."""
    for first, data, ends in blocks(values):
        starts, _, names = word_names(data)
        of = np.searchsorted(ends, starts, side="right")
        weight = np.concatenate(([0.0], np.cumsum(idf[(names % np.uint64(len(idf))).astype(np.int64)], dtype=np.float64)))
        shingles = combined(names, size)
        whole = of[: len(shingles)] == of[size - 1 :][: len(shingles)]
        at = np.flatnonzero(whole)
        owner, shingle, w = of[at], shingles[at], (weight[at + size] - weight[at]) / size
        counts = np.bincount(of, minlength=len(ends))
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            begin = np.cumsum(counts) - counts
            few = [(combined(names[begin[i] : begin[i] + counts[i]], int(counts[i]))[0], (weight[begin[i] + counts[i]] - weight[begin[i]]) / counts[i]) for i in short]
            owner, shingle, w = np.append(owner, short), np.append(shingle, np.array([f[0] for f in few], np.uint64)), np.append(w, [f[1] for f in few])
        if not len(owner):
            continue
        order = np.lexsort((shingle, owner))
        owner, shingle, w = owner[order], shingle[order], w[order]
        new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (shingle[1:] != shingle[:-1])))
        times = np.diff(np.append(new, len(owner)))
        yield first, owner[new], shingle[new], (w[new] * times).astype(np.float32)


def icws(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and ``samples`` ICWS samples of each; rows must be sorted by text."""
    starts = np.flatnonzero(np.append(True, np.diff(owner) != 0))
    sizes = np.diff(np.append(starts, len(owner)))
    log_weight = np.log(weight)
    low = (shingle ^ (shingle >> np.uint64(32))).astype(np.uint32)
    high = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((samples, len(starts)), np.uint64)
    rng = np.random.default_rng(11)
    for k in range(samples):
        a, b = (np.uint32(x | 1) for x in rng.integers(0, 2**32, 2, dtype=np.uint64))
        u = low * a + high * b
        u = (u ^ (u >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        u = (u ^ (u >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        u = u ^ (u >> np.uint32(16))
        r, beta = _GAMMA[u & np.uint32(2047)], _UNIFORM[u >> np.uint32(22)]
        t = np.floor(log_weight / r + beta)
        log_a = _LOG_GAMMA[(u >> np.uint32(11)) & np.uint32(2047)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        hits = hits[np.unique(owner[hits], return_index=True)[1]]
        out[k] = mixed(shingle[hits] + t[hits].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner[starts], out


def _keys(batches: Iterator[pa.RecordBatch], idf: np.ndarray, size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        values = list(texts(batch))
        keys: list = [None] * len(values)
        for first, owner, shingle, weight in _weighted([t.lower() for t in values], idf, size):
            found, samples = icws(owner, shingle, weight, bands * rows)
            by_band = np.stack([combined(samples[b * rows : (b + 1) * rows].T.copy(), 1).T for b in range(bands)])
            name = by_band[:, 0]
            for i in range(1, rows):
                name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + by_band[:, i])
            name = mixed(name + np.arange(bands, dtype=np.uint64)[:, None]).view(np.int64).T.tolist()
            for i, key in zip(found.tolist(), name):
                keys[first + i] = key
        second = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in values]
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), batch.column("t"), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["d", "t", "s", "keys"]
        )


def _sets(batches: Iterator[pa.RecordBatch], idf: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Shingle names and weights of each text as byte strings."""
    for batch in small(batches):
        names: list = [b""] * batch.num_rows
        weights: list = [b""] * batch.num_rows
        for first, owner, shingle, weight in _weighted([t.lower() for t in texts(batch)], idf, size):
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(owner) != 0)), len(owner))
            for a, b in zip(cuts[:-1], cuts[1:]):
                names[first + owner[a]], weights[first + owner[a]] = shingle[a:b].tobytes(), weight[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(names, pa.binary()), pa.array(weights, pa.binary())], ["v", "names", "weights"])


def _set_of(names: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(names, np.uint64), np.frombuffer(weights, np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets with sorted names."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    common = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum(dtype=np.float64)
    return float(common / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common))


def _star_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of members with their leader; rows come in order of (m, salt), the leader first."""
    group, leader = None, None
    for batch in batches:
        out = []
        for m, salt, v, names, weights in zip(*(batch.column(c).to_pylist() for c in ("m", "salt", "v", "names", "weights"))):
            own = _set_of(names, weights)
            if (m, salt) != group:
                group, leader = (m, salt), own
            elif weighted_jaccard(leader, own) >= similarity - 1e-9:
                out.append((v, m))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["u", "v"])


def links_of(
    vertices: list[int], parts: list[int], names: list[np.ndarray], weights: list[np.ndarray], similarity: float
) -> list[tuple[int, int]]:
    """Links that join all that are joined by links of at least ``similarity``, without comparing those already joined.

    Vertices of one part are joined beforehand.
    """
    sizes = np.array([len(n) for n in names])
    unique, column = np.unique(np.concatenate(names), return_inverse=True)
    value = np.concatenate(weights).astype(np.float64)
    part = np.unique(np.array(parts), return_inverse=True)[1]
    left = np.arange(len(vertices))
    starts = np.cumsum(sizes) - sizes
    totals = np.array([w.sum(dtype=np.float64) for w in weights])
    dense = np.zeros(len(unique))
    found, queue = [], []
    rows = (starts, np.arange(len(vertices)), column, value)
    while len(left):
        if not queue:
            queue = left[part[left] == part[left[0]]].tolist()
            left = left[part[left] != part[left[0]]]
            if not len(left):
                break
        if len(left) * 2 < len(rows[1]):  # those reached leave the arrays
            take = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in left])
            rows = (np.cumsum(sizes[left]) - sizes[left], left, column[take], value[take])
        at = queue.pop()
        own = slice(starts[at], starts[at] + sizes[at])
        dense[column[own]] = value[own]
        common = np.add.reduceat(np.minimum(rows[3], dense[rows[2]]), rows[0])
        dense[column[own]] = 0
        alike = common / (totals[rows[1]] + totals[at] - common) >= similarity - 1e-9
        near = np.intersect1d(rows[1][alike], left, assume_unique=True)
        if len(near):
            found += [(vertices[at], vertices[i]) for i in near.tolist()]
            reached = left[np.isin(part[left], part[near])]
            queue += reached.tolist()
            left = np.setdiff1d(left, reached, assume_unique=True)
    return found


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of each task's components; rows come in order of (root, p, q)."""
    group, rows = None, {}

    def links() -> pa.RecordBatch:
        parts, sets = [r[0] for r in rows.values()], [r[1] for r in rows.values()]
        found = links_of(list(rows), parts, [s[0] for s in sets], [s[1] for s in sets], similarity) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for root, p, q, v, part, names, weights in zip(*(batch.column(c).to_pylist() for c in ("root", "p", "q", "v", "part", "names", "weights"))):
            if (root, p, q) != group and rows:
                yield links()
                rows = {}
            group = (root, p, q)
            rows[v] = part, _set_of(names, weights)
    if rows:
        yield links()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    block_bytes: int = BLOCK_BYTES,
    star_rows: int = STAR_ROWS,
) -> DataFrame:
    """One row per input row: id, t (name of the text), class_id, group_id, n_class (rows with this text), kept.

    class_id is the smallest id with the same text, group_id the smallest class_id of the classes joined by links. ``kept`` is true
    for the row of the class that leads its group; rows that repeat its id and text are all marked. Texts that are null or have no words are never
    linked: each such row is a class of its own and kept. A class without an id, or whose smallest id another class has too and comes first by name,
    gets a negative class_id from its text. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    idf = word_idf(read.select("text"))
    keyed = read.mapInArrow(lambda b: _keys(b, idf, shingle, bands, rows), "d bigint, t bigint, s bigint, keys array<bigint>")
    keyed = stored(keyed, "keys")
    classes = keyed.where("keys IS NOT NULL").groupBy("t", "s", "keys").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("v", F.xxhash64("t", "s")), "classes")
    in_bucket = classes.select("v", F.explode("keys").alias("key"))
    buckets = in_bucket.groupBy("key").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = stored(in_bucket.join(buckets, "key").where("v != m").groupBy("v", "m").agg(F.count(F.lit(1)).alias("shared")), "star")
    candidates = stored(components(star.select(F.col("v").alias("u"), F.col("m").alias("v")), "candidates").withColumnsRenamed({"v": "root", "u": "v"}), "candidates")
    wanted = candidates.join(classes.select("v", F.col("d").alias("rd"), F.col("t").alias("rt")), "v")
    with_text = read.join(wanted, read["d"].eqNullSafe(wanted["rd"]) & (read["t"] == wanted["rt"])).select("v", "text")
    sets = with_text.mapInArrow(lambda b: _sets(b, idf, shingle), "v bigint, names binary, weights binary")
    sets = stored(sets.groupBy("v").agg(F.first("names").alias("names"), F.first("weights").alias("weights")), "sets")

    chosen = star.groupBy("v").agg(F.max_by("m", F.struct("shared", "m")).alias("m"))
    salts = stored(chosen.groupBy("m").agg(F.expr(f"1 + count(*) div {star_rows}").alias("salts")), "leaders")
    members = chosen.join(salts, "m").withColumn("salt", F.expr("pmod(xxhash64(v), salts)"))
    leaders = salts.select("m", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col("m").alias("v"))
    pairs = leaders.unionByName(members.select("m", "salt", "v")).join(sets, "v").withColumn("leads", F.col("v") == F.col("m"))
    pairs = pairs.repartition("m", "salt").sortWithinPartitions("m", "salt", F.col("leads").desc())
    first_links = stored(pairs.mapInArrow(lambda b: _star_links(b, similarity), "u bigint, v bigint"), "star-links")
    parts = components(first_links, "parts").withColumnsRenamed({"v": "part", "u": "v"})
    placed = stored(candidates.join(parts, "v", "left").withColumn("part", F.coalesce("part", "v")), "parts")

    open_roots = placed.groupBy("root").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("root")
    open_sets = placed.join(open_roots, "root").join(sets, "v")
    blocks = placed.join(open_roots, "root").join(sets.select("v", F.expr("octet_length(names) + octet_length(weights)").alias("size")), "v")
    blocks = stored(blocks.groupBy("root").agg(F.expr(f"1 + sum(size) div {block_bytes}").alias("blocks")), "blocks")
    dealt = (
        open_sets.join(blocks, "root")
        .withColumn("own", F.expr("pmod(xxhash64(v), blocks)"))
        .withColumn("other", F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), i -> i <> own))")))
        .select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "v", "part", "names", "weights")
        .repartition("root", "p", "q")
        .sortWithinPartitions("root", "p", "q")
    )
    links = dealt.mapInArrow(lambda b: _verified(b, similarity), "u bigint, v bigint").unionByName(first_links)
    groups = components(links, "links").withColumnsRenamed({"v": "g", "u": "v"})

    from_text = F.expr("-1 - (t & 4611686018427387903)")
    owners = classes.groupBy("d").agg(F.min(F.struct("t", "s")).alias("owner"))
    own = classes.drop("keys").join(owners, "d", "left")
    own = own.withColumn("class_id", F.when(F.col("owner") == F.struct("t", "s"), F.col("d")).otherwise(from_text))
    grouped = own.join(groups, "v", "left").withColumn("g", F.coalesce("g", "v"))
    heads = grouped.groupBy("g").agg(F.min(F.struct("class_id", "t", "s")).alias("head"))
    led = grouped.join(heads, "g").withColumn("leads", F.struct("class_id", "t", "s") == F.col("head"))
    led = led.select("t", "s", F.col("d").alias("first"), "class_id", F.col("head.class_id").alias("group_id"), "n", "leads")
    alone = F.coalesce("d", from_text)
    return (
        keyed.drop("keys")
        .join(led, ["t", "s"], "left")
        .select(
            F.col("d").alias(id_column),
            "t",
            F.coalesce("class_id", alone).alias("class_id"),
            F.coalesce("group_id", alone).alias("group_id"),
            F.coalesce("n", F.lit(1)).alias("n_class"),
            F.expr("class_id IS NULL OR (leads AND d <=> first)").alias("kept"),
        )
    )
