"""Row-wise operators and the language model against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import lbl
from fleetlens.llm.decontam import contaminated
from fleetlens.llm.fertility import block_entropies, fertility
from fleetlens.llm.langid import FILTERS, Predictor, drop_unclear, gradients, identify, new_network, windows_of
from fleetlens.llm.lbl import log_bilinear_scores
from fleetlens.llm.licenses import PHRASES, TEMPLATES, Automaton, Scanner, scan_licenses
from fleetlens.llm.queries import FERTILITY_VOCABULARIES
from fleetlens.llm.tokens import Vocabulary


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- fertility


def plain(text):
    w = words(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(words(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_plain_measures_and_odd_rows(docs, odd, empty):
    for table in (docs, odd):
        got = fertility(table, FERTILITY_VOCABULARIES).collect()
        want = [(r.doc_id, *plain(r.text)) for r in table.select("doc_id", "text").collect()]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:6]) for r in got)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert fertility(empty, FERTILITY_VOCABULARIES).count() == 0


def test_a_text_that_fits_no_vocabulary_is_rejected(spark, docs):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randint(0x12000, 0x12300)) for _ in range(6)) for _ in range(80))
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(99_999, noise, "en")], "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in fertility(table, FERTILITY_VOCABULARIES).collect()}
    assert not got[99_999].kept and not got[99_999].base_failed and min(got[99_999].fallback_share) > 0.5


def test_long_texts_and_rare_languages_are_judged(spark, docs):
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(chr(rng.randint(0x12000, 0x12300)) for _ in range(6)) for _ in range(n))
    clean = " ".join(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").collect() if r.text and plain(r.text)[4] == 0)
    vocabulary = rng.sample(sorted(set(words(clean))), 400)
    long = " ".join(rng.choices(vocabulary, k=10_000))
    rows = [(99_991, noise(10_000), "en"), (99_992, noise(300), "xx"), (99_993, noise(20_000), None), (99_994, long, "en")]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in fertility(table, FERTILITY_VOCABULARIES).where("doc_id > 99990").collect()}
    assert {d: (r.base_failed, r.kept) for d, r in got.items()} == {99_991: (False, False), 99_992: (False, False), 99_993: (False, False), 99_994: (False, True)}


def test_block_entropies_have_no_length():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.5, 100_000).astype(np.int32)
    values = block_entropies([ids[:n] for n in (2_000, 20_000, 100_000)])
    assert max(values) - min(values) < 0.02
    entropy = lambda x: -sum(c / len(x) * math.log(c / len(x)) for c in collections.Counter(x.tolist()).values()) / math.log(len(x))
    got = block_entropies([ids[:49], ids[:50], ids[:0], ids[100:220]])
    assert np.isnan(got[0]) and abs(got[1] - entropy(ids[:50])) < 1e-9 and np.isnan(got[2])
    assert abs(got[3] - np.mean([entropy(ids[a : a + 50]) for a in (100, 150, 170)])) < 1e-9


def test_junk_goes_and_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    rows = fertility(spark.read.parquet(f"{sf}/documents.parquet"), FERTILITY_VOCABULARIES).where("NOT base_failed")
    labelled = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in labelled.collect()}
    assert kept[1] > 0.995 and kept[0] < 0.5


# --- language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows_have_a_language_or_und(odd, empty):
    rows = identify(odd).collect()
    assert len(rows) == odd.count()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 4)] == ["und"] * 3
    assert identify(empty).count() == 0 and drop_unclear(empty, 0.3).count() == 0
    nothing = identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    kept = drop_unclear(odd, 0.0)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 4)").count() == 0 and kept.where("doc_id = 3").count() == 2


def test_gradients_and_tables_agree_with_the_network():
    net, rng = new_network(["a", "b", "c"]), np.random.default_rng(0)
    for offset in net.offsets:
        offset += 0.1
    x, y = rng.integers(1, 120, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = gradients(net, x, y)
    for p, g in zip(net.parameters(), grads):
        for at in list(np.argwhere(np.abs(g) > 1e-3))[:4]:
            at, step = tuple(at), 1e-2
            p[at] += step
            up = gradients(net, x, y)[0]
            p[at] -= 2 * step
            down = gradients(net, x, y)[0]
            p[at] += step
            assert abs((up - down) / (2 * step) - g[at]) < 0.05 * max(abs(g[at]), 0.05)
    hidden = []
    for width, filters, offset in zip((2, 3, 4), net.filters, net.offsets):
        columns = np.stack([net.embedding[x[:, i : i + width]].reshape(5, -1) for i in range(40 - width + 1)], 1)
        hidden.append(np.maximum((columns @ filters).max(1) + offset, 0))
    z = np.exp(np.concatenate(hidden, 1) @ net.weights + net.bias)
    assert np.allclose(Predictor(net).probabilities(x), z / z.sum(1, keepdims=True), atol=1e-5) and hidden[0].shape[1] == FILTERS


def test_windows_cover_the_text():
    assert b"".join(w.tobytes() for w in windows_of(b"abc" * 300)).rstrip(b"\0") == b"abc" * 300
    assert windows_of(b"").shape == (1, 256)


# --- licences


def test_phrases_against_plain_search(docs, odd, empty, spark):
    extra = [(-2, "MIT License mit license! General  public-license\nApache, license x mit"), (-3, "é mit mit license apache apache license")]
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    phrases = [(p.split(), label) for p, label in PHRASES]
    want = []
    for r in table.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text or ""))
        places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        want.append((r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    got = scan_licenses(table).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:6]) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(empty).count() == 0


def test_matching_statistics_are_the_longest_runs():
    rng = random.Random(8)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = Automaton(sequences)
    number = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
    text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(300)]
    coded = np.array([number.get(w, -1) for w in text])
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    _, length = automaton.matches(coded, np.zeros(300, np.int64))
    for i in range(300):
        assert length[i] == max((n for n in range(i + 2) if n == 0 or tuple(text[i - n + 1 : i + 1]) in runs), default=0)


def test_templates_with_a_changed_word_are_found():
    scanner = Scanner()
    for label, text in TEMPLATES:
        w = text.split()
        if len(w) > 12:
            w[len(w) // 2] = "zebra"
        (row,) = scanner.scan([("Some words before. " + " ".join(w) + " and after").lower().encode()])
        assert label in row[5].split(","), (label, text)
    assert [r[5] for r in scanner.scan([b"the license of the software is to be a copy of this", b"permission to use a copy"])] == ["", ""]


# --- benchmark decontamination

ITEM = "A train leaves the old station at 60 miles per hour and another follows it at 80 miles per hour after 2 hours so when do they meet near Boston"


def test_templates_catch_new_parameters(spark):
    other = "an entirely different question that asks for the sum of the first few odd numbers and nothing more"
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, "too short"), (4, None), (5, "just five plain words here")], "item_id bigint, text string")
    changed = ITEM.replace("60", "75").replace("80", "95").replace("Boston", "New York").replace("miles", "km")
    muddled = "at 1 miles per hour and another follows it at 2 miles per hour . at 3 km per hour and another follows it at 4 km per hour"
    rows = [
        (1, "filler words go here. " + ITEM + " and then some more filler."),
        (2, "filler words go here. " + changed + " and then some more filler."),
        (3, "a clean document that talks about trains and stations at some length without asking anything of anyone"),
        (4, None),
        (5, ""),
        (6, "it says just five plain words here and goes on"),
        (7, ITEM),
        (7, ITEM),
        (None, ITEM),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 5), (7, 1), (None, 1)}
    assert got[2, 1].reparameterised and got[2, 1].n_conflicts == 0 and got[2, 1].n_slots >= 3
    assert not got[1, 1].reparameterised and got[1, 1].cover > 0.9
    assert muddled and contaminated(docs.where("false"), items).count() == 0
    assert contaminated(docs, items.where("false")).count() == 0


def test_inconsistent_slots_are_not_the_same_question(spark):
    item = "buy 5 red apples and 5 green pears then sell 5 red apples and 5 green pears to get the total of 5"
    docs = spark.createDataFrame([(1, item.replace("5", "9")), (2, re.sub("5", lambda m, n=iter("123456789"): next(n), item))], "doc_id bigint, text string")
    got = contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_case_and_what_stands_before_a_word_do_not_hide_an_item(spark):
    german = "Der alte Zug verließ den Bahnhof der Stadt mit 60 km und der Bus folgte dem Zug nach 2 Stunden auf der Straße nach Berlin"
    wrapped = "the river flows through Vienna and then 9 bridges cross it before Budapest where 7 boats wait for the Danube ferry"
    items = [(1, german), (2, "What is the boiling point of 3 litres water"), (3, wrapped)]
    rows = [
        (1, "davor. " + german.lower().replace("60", "75").replace("2 ", "4 ") + " danach"),
        (2, "davor. " + german.upper().replace("60", "75").replace("2 ", "4 ") + " danach"),
        (3, "Q1) What is the boiling point of 5 litres water? It is said"),
        (4, "see " + wrapped.replace("9", "8").replace("7", "6").replace("Vienna", "\nVienna").replace("Budapest", "\nBudapest").replace("Danube", "\nDanube")),
        (5, "the old train left the station and what is the point of boiling water in vienna"),
    ]
    got = contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert all(r.reparameterised and r.n_slots > 0 for r in got)


SHORT_ITEMS = [
    (1, "水的沸点是多少度？请选择正确的答案。"),
    (2, "Solve 3x + 5 = 2x + 9."),
    (3, "WHICH PLANET IS THE LARGEST OF ALL"),
    (4, "12 7 9 33 101 5 8 13 21 34 55"),
    (5, "น้ำเดือดที่กี่องศา"),
    (6, "Name it"),
    (7, "?!"),
]


def test_every_item_with_a_word_is_found_verbatim(spark):
    rows = [(i, f"Some text before. {text} Then some text after it.") for i, text in SHORT_ITEMS]
    rows += [(10, "这是另外一个关于天气的句子。"), (11, "Solve 4x + 5 = 2x + 9."), (12, "which planet is it of them all"), (13, "12 7 9 33 101 5 8"), (14, "?!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = contaminated(docs, spark.createDataFrame(SHORT_ITEMS, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(1, 7)]


def test_planted_items_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r.doc_id, " ".join(re.findall(r"\w+", r.text.lower()))) for r in docs.collect()]
    whole = {(d, r.item_id) for r in items.collect() for d, t in texts if " ".join(re.findall(r"\w+", r.text.lower())) in t}
    got = contaminated(docs, items).collect()
    assert whole <= {(r.doc_id, r.item_id) for r in got}
    text = dict(texts)
    item = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in items.collect()}
    for r in got:
        w = item[r.item_id]
        assert any(" ".join(w[i : i + 10]) in text[r.doc_id] for i in range(len(w) - 9))


# --- language model


@pytest.fixture(scope="module")
def scored(docs, odd):
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id <> 5 OR doc_id IS NULL")).cache()
    return table.collect(), log_bilinear_scores(table.repartition(3)).collect()


def test_base_score_is_exact(scored):
    rows, got = scored
    tokens = {(r.doc_id, r.text): [lower(w) for w in words(r.text)] + [None] for r in rows}
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    counts = collections.Counter(t for r in rows if not held(r.doc_id) for t in tokens[r.doc_id, r.text])
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id is None, r.doc_id or 0, held(r.doc_id), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for r in rows for t in [tokens[r.doc_id, r.text]])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_without_training_texts(spark, empty):
    alone = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in log_bilinear_scores(alone).collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert log_bilinear_scores(empty).count() == 0


def made_model(tokens, passes):
    rng = np.random.default_rng(3)
    counts = collections.Counter(tokens.tolist())
    model = lbl.new_model([(k, v) for k, v in sorted(counts.items())], len(tokens) + 20, 20)
    owner = np.sort(rng.integers(0, 20, len(tokens)))
    of, target, two, one = lbl.sequences(owner, model.classes_of(tokens.view(np.uint64)), 20)
    squares = [np.full_like(p, 1e-2) for p in model.parameters()]
    for i in range(passes):
        lbl.train_on(model, squares, two, one, target, seed=i)
    return model, two, one, target


def test_probabilities_sum_to_one_and_contrast_learns_order():
    rng = np.random.default_rng(1)
    step = rng.random(20_000) < 0.9
    tokens = np.zeros(20_000, np.int64)
    for i in range(1, 20_000):
        tokens[i] = (tokens[i - 1] + 1) % 12 if step[i] else rng.integers(0, 12)
    model, two, one, target = made_model(tokens, 40)
    classes = len(model.bias)
    norms = np.full(classes**2, np.nan, np.float32)
    for a, b in ((0, 1), (3, 4), (7, 1)):
        every = model.scores(np.full(classes, a), np.full(classes, b), np.arange(classes), norms)
        assert abs(np.exp(every).sum() - 1) < 1e-4
    unigram = np.log(model.noise)[target].mean()
    assert model.scores(two, one, target, norms).mean() > unigram + 0.5


def test_chunks_of_a_partition_are_bounded(spark, monkeypatch):
    """Scores don't depend on them; one partition was one chunk, and had to fit in a task."""
    values = ["a bc " * 100, None, "d " * 900, "", "a d"] * 5
    batches = [pa.RecordBatch.from_pydict({"text": values[a : a + 7]}) for a in range(0, len(values), 7)]
    monkeypatch.setattr(lbl, "CHUNK_BYTES", 2000)
    got = [row for batch in lbl._in_chunks(iter(batches), 3) for row in batch.to_pylist()]
    assert [r["text"] for r in got] == values
    sizes = collections.defaultdict(list)
    for r in got:
        sizes[r["chunk"]].append(len(r["text"] or ""))
    assert len(sizes) > 3 and {c >> 32 for c in sizes} == {3} and all(sum(s[:-1]) < 2000 for s in sizes.values())

    table = spark.createDataFrame([(i, f"{t or ''} w{i}") for i, t in enumerate(values)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(lbl, "CHUNK_BYTES", 1 << 24)
    once = {r.doc_id: r.asDict() for r in log_bilinear_scores(table).collect()}
    dealt = lbl._in_chunks

    def finely(batches):
        lbl.CHUNK_BYTES = 700
        return dealt(batches)

    monkeypatch.setattr(lbl, "_in_chunks", finely)
    again = {r.doc_id: r.asDict() for r in log_bilinear_scores(table).collect()}
    assert again.keys() == once.keys()
    for d, row in again.items():
        assert all(abs(row[c] - once[d][c]) < 1e-4 for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))


def test_sequences():
    of, target, two, one = lbl.sequences(np.array([0, 0, 2]), np.array([5, 6, 7]), 3)
    assert of.tolist() == [0, 0, 0, 1, 2, 2] and target.tolist() == [5, 6, 1, 1, 7, 1]
    assert one.tolist() == [1, 5, 6, 1, 1, 7] and two.tolist() == [1, 1, 5, 1, 1, 1]


def test_fertility_measures_are_those_of_whole_texts(docs):
    """Every measure of every text, from the ids of each vocabulary by itself."""
    got = {r.doc_id: r for r in fertility(docs, FERTILITY_VOCABULARIES).collect()}
    held = [Vocabulary(path) for path in FERTILITY_VOCABULARIES]
    fallback = [v.fallback() for v in held]
    for row in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text)
        if not words:
            continue
        chars = sum(map(len, words))
        ids = [sum(held[0].encode(words), []), held[1].encode([row.text])[0]]
        for k, own in enumerate(ids):
            share = np.array(list(collections.Counter(own).values())) / len(own)
            entropy = float(-(share * np.log(share)).sum() / np.log(len(own))) if len(own) > 1 else 1.0
            r = got[row.doc_id]
            assert r.chars_per_token[k] == chars / len(own)
            assert abs(r.fallback_share[k] - fallback[k][own].mean()) < 1e-12
            assert abs(r.token_entropy[k] - entropy) < 1e-9


def test_short_items_are_marked(spark):
    """An item of one word stands in ordinary sentences; its window tells that it is short."""
    docs = spark.createDataFrame([(1, "Yes, we went to the market and bought what we needed"), (2, "nothing here")], "doc_id bigint, text string")
    long = "how many of the seven grey horses that crossed the wide river came back at night"
    items = spark.createDataFrame([(1, "Yes"), (2, long)], "item_id bigint, text string")
    more = docs.unionByName(spark.createDataFrame([(3, f"Somebody asked {long} and left")], docs.schema))
    found = {(r.doc_id, r.item_id): r.window_words for r in contaminated(more, items).collect()}
    assert found[1, 1] == 1 and found[3, 2] == 8 and (2, 1) not in found
