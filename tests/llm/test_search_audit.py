"""Ranked search, the divergence audit and exact groups against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import SMALL
from oracle_check import compare, connect
from pyspark.sql import functions as F

from fleetlens.llm.divergence import source_divergence
from fleetlens.llm.exact_dedup import ContentTable, exact_groups
from fleetlens.llm.queries import LLM_ORACLES, LLM_QUERIES
from fleetlens.llm.ranked_search import RangeMaxima, ShardIndex, ranked_search
from fleetlens.llm.terms import distinct, named

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEW = ("op11_range_max_search", "op12_late_divergence_audit", "op13_grace_exact_dedup")


def clashing(rows):
    """The same rows with more columns, named as the operators name theirs."""
    for name in ("row", "digest", "content", "path", "parts", "part", "first", "n", "l", "g", "word", "term", "query", "rank", "item", "shard", "p", "q"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


def plain(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.mark.parametrize("name", NEW)
def test_same_as_sql(spark, name):
    _, difference = compare(spark, connect(SMALL), SMALL, LLM_QUERIES[name], LLM_ORACLES[name])
    assert difference is None


# Exact groups


def brute_groups(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[text or ""].append(ident)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        one = ids.index(keep)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(ident, keep, len(ids), at == one, digest) for at, ident in enumerate(ids)]
    return sorted(out, key=repr)


def copies(rng):
    """A third of the rows are one text, another share two long ones, and some contents differ in their last byte only."""
    hot, long = "hot text " * 40, ["long " * 3000 + str(i) for i in range(2)]
    rows = []
    for i in range(2500):
        kind = rng.random()
        text = hot if kind < 0.35 else long[i % 2] if kind < 0.4 else f"{'w' * rng.randrange(60)}{rng.randrange(300)}"
        rows.append((i, text))
    return rows + [(None, None), (None, ""), (5, ""), (7, "x"), (7, "x"), (None, hot), (None, "only without an id")]


@pytest.mark.parametrize("table_bytes, table_records", [(16 << 20, 1 << 16), (20_000, 100), (3_000, 7)])
def test_exact_groups_in_any_number_of_spills(spark, table_bytes, table_records):
    rows = copies(random.Random(3))
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9))
    assert plain(exact_groups(docs, table_bytes=table_bytes, table_records=table_records)) == brute_groups(rows)


def test_exact_groups_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert plain(exact_groups(odd)) == brute_groups(rows)
    assert exact_groups(empty).count() == 0


def test_contents_decide_where_digests_are_equal():
    table = ContentTable(slots=2)
    contents = [b"%d" % (i % 700) for i in range(2000)]
    entries = [table.entry(i % 3, c) for i, c in ((int(c), c) for c in contents)]
    assert [table.contents[e] for e in entries] == contents
    assert len(table.contents) == 700


# Divergence


def brute_divergence(rows, least=3, top=200):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, documents, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(pattern.findall((text or "").translate(LOWER)))
        counts[lang, source].update(found)
        documents[lang].update(found.keys())
        sources[lang].add(source)
    out = []
    for lang, named_sources in sources.items():
        kept = [w for w, n in documents[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in named_sources), Counter())

        def weight(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p, q = {s: weight(counts[lang, s]) for s in named_sources}, weight(whole)
        for s in named_sources:
            parts = {
                "pair": [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in named_sources if o != s],
                "term": [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]],
            }
            for part, found in parts.items():
                found.sort(key=lambda item: (-item[1], item[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out, key=repr)


ODD_GROUPS = [
    (None, None, None),
    ("", None, "z"),
    ("only odd here", None, "z"),
    ("Ünï code ünÏ code", "xx", "a"),
    ("ünï x1y", "xx", "a"),
    ("ünï 9", "xx", "b"),
    (None, "yy", "q"),
    (None, "yy", "r"),
    ("long " * 50_000, "xx", "a"),
]


@pytest.fixture(scope="module")
def grouped(spark, docs):
    more = spark.createDataFrame(ODD_GROUPS, "text string, lang string, source string")
    return docs.select("text", "lang", "source").unionByName(more).repartition(5).cache()


@pytest.fixture(scope="module")
def divergence(grouped):
    return brute_divergence([tuple(r) for r in grouped.collect()])


@pytest.mark.parametrize("how", [{}, {"digest_bits": 10}, {"chunk_rows": 500, "block_cells": 3000}, {"digest_bits": 5, "chunk_rows": 200}])
def test_divergence_with_any_digest_width(grouped, divergence, how):
    """Digests of few bits are shared by many terms, which have to be split."""
    assert plain(source_divergence(clashing(grouped), **how)) == divergence


def test_divergence_cuts_ties_by_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert plain(source_divergence(docs, top_terms=7)) == brute_divergence(rows, top=7)


def test_divergence_of_nothing(odd, empty):
    assert source_divergence(empty).count() == 0
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert plain(source_divergence(odd)) == brute_divergence(rows)


def test_only_numbers_are_shuffled_before_the_report(grouped, capsys):
    """The last plan sorts strings of the report only; terms reach it by a join on digests."""
    source_divergence(grouped).explain("formatted")
    plan = capsys.readouterr().out
    assert "text#" not in plan


def test_equal_names_are_told_apart_by_bytes():
    data = np.frombuffer(b"aa bb aa cc bb dddd " + b"x" * 5000 + b" " + b"x" * 4999 + b"y " + b"x" * 5000 + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends[:-1] + 1)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for bits in (64, 1, 0):
        number, holder = distinct(data, starts, ends, named(data, starts, ends, bits))
        assert [words[holder[n]] for n in number] == words
        assert len(holder) == len(set(words))


# Ranked search


def search_terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))


def brute_search(docs, items, top=20):
    counted = [(ident, search_terms(text)) for ident, text in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    held = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        asked, scores = search_terms(text), []
        for ident, found in counted:
            m = 75 + 25 * found.total() * n_docs // n_terms if found else 0
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * (10**9 * found[w] // (1000 * found[w] + 12 * m))
                for w, k in asked.items()
                if found[w]
            )
            if score > 0:
                scores.append((-score, ident is not None, ident or 0, ident))
        out += [(item, i, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched(spark, docs):
    more = [(None, "Ünï code alpha"), (None, None), (7, ""), (7, "alpha beta alpha 42"), (7, "alpha beta alpha 42"), (900, "alpha"), (901, "alpha " * 30_000)]
    items = [(None, "alpha 42 alpha"), (-1, None), (-2, ""), (-2, "zzzunknownzz"), (-3, "ALPHA ünï the")]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(5).cache()
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    asked = asked.unionByName(spark.createDataFrame(items, "item_id bigint, text string"))
    return texts, asked, brute_search([tuple(r) for r in texts.collect()], [tuple(r) for r in asked.collect()])


@pytest.mark.parametrize("how", [{}, {"shard_documents": 16}, {"block_bytes": 2000}, {"shard_documents": 1}])
def test_search_over_any_shards_and_blocks(searched, how):
    docs, items, want = searched
    assert plain(ranked_search(clashing(docs), clashing(items), **how)) == want


def test_search_of_nothing(odd, empty, searched):
    docs, items, _ = searched
    assert ranked_search(empty, items).count() == 0
    assert ranked_search(docs, items.where("false")).count() == 0
    want = brute_search([(r.doc_id, r.text) for r in odd.collect()], [(1, "words long 3 the")])
    asked = items.limit(1).select(F.lit(1).alias("item_id"), F.lit("words long 3 the").alias("text"))
    assert plain(ranked_search(odd, asked)) == want


def test_equal_scores_of_many_copies_rank_by_id(spark):
    docs = spark.createDataFrame([((i * 37) % 500, "the same few words") for i in range(500)], "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([(1, "few words")], "item_id bigint, text string")
    more = docs.unionByName(spark.createDataFrame([(1000, "none of it")], "doc_id bigint, text string"))
    found = ranked_search(more, items, shard_documents=64).orderBy("rank").collect()
    assert [r.doc_id for r in found] == list(range(20))


def test_range_maxima_against_scans():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 9, 300)
    maxima = RangeMaxima(values, 300)
    start = rng.integers(0, 300, 2000)
    end = start + 1 + (rng.random(2000) * (300 - start)).astype(np.int64)
    at = maxima.places(start, end)
    assert ((at >= start) & (at < end)).all()
    assert all(values[i] == values[a:b].max() for i, a, b in zip(at, start, end))


def test_search_scores_few_documents_of_a_shard():
    """Bounds cut most of a shard off, and what is left holds the best."""
    rng = np.random.default_rng(5)
    documents, terms = 4000, 12
    held = rng.random((terms, documents)) < 0.3
    term, place = np.nonzero(held)
    impact = rng.integers(1, 1000, len(term)) ** 2
    impact[rng.random(len(term)) < 0.02] *= 30
    index = ShardIndex.of(term, place, impact, terms, documents)
    scores = np.zeros((terms, documents), np.int64)
    scores[term, place] = impact
    weights = rng.integers(1, 50, terms)
    want = (scores * weights[:, None]).sum(0)
    place, score = index.search(np.arange(terms), weights, 20)
    assert (want[place] == score).all()
    assert sorted(score.tolist())[-20:] == sorted(want.tolist())[-20:]
    assert len(place) < 60
