"""Suffix dedup and near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_support import brute_repeats, near_rows

from fleetlens.llm.components import components
from fleetlens.llm.minhash import SIMILARITY, _weighted, icws, links_of, near_duplicates, weighted_jaccard, word_idf
from fleetlens.llm.suffix_dedup import cut_repeats, remove_repeats, repeated_starts


def made_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(25)
    texts = [prose(40) + passage + prose(10), passage, prose(5) + passage[7:] + other, other + prose(30) + other, "ab" * 300, "x" * 199, "x" * 200, "x" * 200]
    texts += [passage[: rng.randint(100, 300)] + prose(3) + passage[rng.randint(0, 90) :] for _ in range(12)]
    return [t.encode() for t in texts + [""]]


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_every_repeated_byte_goes(spark, bucket_rows):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:5] for r in remove_repeats(docs, bucket_rows=bucket_rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


@pytest.mark.parametrize("window", [8, 9, 24, 200])
def test_refinement_equals_counting(window):
    segments = [t for t in made_texts(2) if len(t) >= window]
    count = Counter(s[i : i + window] for s in segments for i in range(len(s) - window + 1))
    for s, flags in zip(segments, repeated_starts(segments, window)):
        assert flags.tolist() == [count[s[i : i + window]] > 1 for i in range(len(s) - window + 1)]


def test_odd_rows_and_empty_tables(odd, empty):
    rows = [tuple(r)[:4] for r in remove_repeats(odd).collect()]
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    want = [(d, *b[:3]) for (d, _), b in zip(texts, brute_repeats([t for _, t in texts if len(t) < 10_000] + [t for _, t in texts if len(t) >= 10_000], 200))]
    assert sorted(map(repr, rows)) == sorted(map(repr, [(d, len(t), *_removed(t, texts)) for d, t in texts])) and len(want) == len(rows)
    assert remove_repeats(empty).count() == 0
    cut = cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert cut_repeats(empty).count() == 0
    assert {r.n_chars for r in cut.where("doc_id = 3").collect()} == {0}


def _removed(text, texts):
    """The repeated row goes, and so does all of a text that repeats itself."""
    if len(text) < 200 or text.startswith(b"no id"):
        return 0, 0
    return len(text), 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    loops = {v for u, v in edges if u == v} - {w for u, v in edges if u != v for w in (u, v)}
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {v: root(v) for v in parent if v not in loops}


def weighted_sets(docs):
    rows = docs.collect()
    idf = word_idf(docs.select("text"))
    sets = {}
    for first, owner, shingle, weight in _weighted([r.text.encode().lower() for r in rows], idf, 5):
        for o, s, w in zip(owner.tolist(), shingle.tolist(), weight.tolist()):
            sets.setdefault(rows[first + o].doc_id, {})[s] = w
    return sets


def similarity(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 6000, "star_rows": 2}])
def test_groups_equal_all_pairs(spark, docs, limits):
    rows = near_rows(spark, docs).cache()
    sets = weighted_sets(rows)
    group = {d: d for d in sets}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a].keys() & sets[b].keys() and similarity(sets[a], sets[b]) >= SIMILARITY:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = near_duplicates(rows, **limits).collect()
    assert {r.doc_id: r.group_id for r in got} == {d: root(d) for d in ids}
    assert sum(r.kept for r in got) == len({root(d) for d in ids})


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**63, 400).astype(np.uint64)
    weight = rng.uniform(0.5, 9, 400).astype(np.float32)
    other = np.where(rng.random(400) < 0.3, weight * 2, weight).astype(np.float32)
    owner = np.repeat([0, 1], 400)
    _, samples = icws(owner, np.append(names, names), np.append(weight, other), 2000)
    want = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    assert abs((samples[:, 0] == samples[:, 1]).mean() - want) < 0.04


def test_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = np.arange(100, dtype=np.uint64)
    names = [np.sort(np.append(base[rng.random(100) < 0.93], np.arange(1000 * i, 1000 * i + 3, dtype=np.uint64))) for i in range(1, 30)]
    weights = [np.ones(len(n), np.float32) for n in names]
    found = links_of(list(range(29)), list(range(29)), names, weights, 0.8)
    sets = [set(n.tolist()) for n in names]
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in found)
    label = list(range(29))
    for pairs in ([(a, b) for a in range(29) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8],):
        for a, b in pairs * 29:
            label[a] = label[b] = min(label[a], label[b])
    linked = list(range(29))
    for a, b in found * 29:
        linked[a] = linked[b] = min(linked[a], linked[b])
    assert linked == label


def test_parts_that_are_joined_are_not_compared_again():
    names = [np.arange(a, a + 10, dtype=np.uint64) for a in (0, 1, 100, 101, 50, 5)]
    weights = [np.ones(10, np.float32)] * 6
    assert links_of(list(range(6)), [0, 0, 2, 2, 4, 0], names, weights, 0.8) == []
    found = links_of(list(range(6)), [0, 1, 2, 3, 4, 5], names, weights, 0.8)
    assert sorted(map(sorted, found)) == [[0, 1], [2, 3]]
    assert weighted_jaccard((names[0], weights[0]), (names[1], weights[0])) == 9 / 11


def test_unrelated_texts_with_one_id_stay_apart(spark):
    prose = lambda seed: " ".join(f"{'abcdef'[seed * i % 6]}{seed}w{i}" for i in range(80))
    rows = [(3, prose(1)), (3, prose(2)), (4, prose(2)), (5, prose(1) + " more"), (6, prose(3))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[3, 4], [3, 5], [6]]
    assert sum(r.kept for r in got) == 3


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and got.columns == ["doc_id", "t", "class_id", "group_id", "n_class", "kept"]
    assert [r.n_class for r in rows if r.doc_id == 3] == [2, 2]
    assert all(r.kept for r in rows) and len({r.group_id for r in rows if r.doc_id in (4, 5, 6)}) == 3
    assert near_duplicates(empty).count() == 0
