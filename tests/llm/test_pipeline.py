"""Every stage on its own input against brute force, on odd rows, and on an empty table."""

import re

import pytest
from llm_support import SMALL, brute_repeats, check_places, ids_of, near_rows
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fleetlens.llm.minhash import near_duplicates

STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, docs):
    """The small documents with near copies, exact copies, a shared passage, a benchmark item and texts in no language."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()
    passage = " ".join(f"passage{i}" for i in range(60))
    more = [(30_000 + i, f"start {i} of its own. {passage} end {i * 7}") for i in range(4)]
    more += [(40_000, f"before it {item.text} and after it"), (50_000, "123 456 ... 789"), (50_001, ""), (50_002, None)]
    rows = near_rows(spark, docs).unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    known = docs.select("doc_id", "lang", "source")
    full = rows.join(known, "doc_id", "left").withColumn("n_chars", F.length("text").cast("long"))
    return full.select(docs.columns).cache()


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_language_keeps_what_has_letters(spark, corpus):
    out = STAGE["language"](spark, corpus, SMALL)
    assert out.columns == corpus.columns
    assert texts(out) == [r for r in texts(corpus) if r[1] and re.search(r"[^\W\d_]", r[1])]


def test_one_document_of_each_group_stays(spark, corpus):
    out = STAGE["near_duplicates"](spark, corpus, SMALL)
    groups = {}
    for r in near_duplicates(corpus).collect():
        groups.setdefault(r.group_id, []).append(r.doc_id)
    assert [d for d, _ in texts(out)] == sorted((min(g) for g in groups.values()), key=repr) and len(groups) < corpus.count()
    assert out.columns == corpus.columns


def test_repeated_passages_go(spark, corpus):
    rows = texts(corpus)
    kept = brute_repeats([(t or "").encode() for _, t in rows], 200)
    out = {r.doc_id: r for r in STAGE["repeated_passages"](spark, corpus, SMALL).collect()}
    assert len(out) == len(rows)
    for (d, text), (_, removed, _, _) in zip(rows, kept):
        if removed:
            assert len(out[d].text.encode()) <= len(text.encode()) - removed and out[d].n_chars == len(out[d].text)
        else:
            assert out[d].text == text
    assert "passage30" not in out[30_000].text and "start 0" in out[30_000].text


def test_benchmark_documents_go(spark, corpus):
    out = {d for d, _ in texts(STAGE["benchmark_passages"](spark, corpus, SMALL))}
    assert 40_000 not in out and {30_000, 50_000, 50_001, 50_002} <= out
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for d, text in texts(corpus):
        words = " ".join(re.findall(r"\w+", (text or "").lower()))
        if any(i in words for i in items):
            assert d not in out


def test_packing_places_everything(spark, corpus):
    rows = STAGE["packing"](spark, corpus, SMALL).collect()
    check_places(rows)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in texts(corpus))


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    for name, stage in pipeline.STAGES[:-1]:
        for table in (odd, empty):
            out = stage(spark, table, SMALL)
            assert out.columns == odd.columns, name
            assert out.count() <= table.count()
    kept = texts(STAGE["near_duplicates"](spark, odd, SMALL))
    assert len(kept) == odd.count() - 1 and [d for d, _ in kept].count(3) == 1


def test_run(spark):
    rows = pipeline.run(spark, SMALL).collect()
    check_places(rows)
    assert 100 < len({r.doc_id for r in rows}) <= 200
