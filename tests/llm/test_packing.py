"""Packing and packed rows: exact ids, gapless places, bounds that hold."""

import random
import zlib

import numpy as np
import pytest
from llm_support import check_places, ids_of
from tokenizers import Tokenizer

from fleetlens.llm.packing import best_fit, lower_bound, pack_sequences
from fleetlens.llm.queries import BYTE_END, BYTE_VOCABULARY, WORD_VOCABULARY
from fleetlens.llm.token_output import FreeRoom, best_fit_decreasing, packed_rows, unpacked


@pytest.mark.parametrize("part_pieces", [100_000, 20])
def test_pieces_are_exact_and_gapless(docs, part_pieces):
    rows = pack_sequences(docs, WORD_VOCABULARY, part_pieces=part_pieces).collect()
    want = {}
    for r in docs.collect():
        ids = ids_of(r.text)
        for a in range(0, len(ids), 2048):
            want[r.doc_id, a // 2048] = (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    made, total = check_places(rows), sum(r.length for r in rows)
    assert made <= -(-total // 2048) * 1.03 + 1


def test_unusual_white_space_and_special_strings(spark):
    texts = ["a b c\x85d\x1ce", "don't <|endoftext|>x É ́x", "ΑΣ Σ İ ﬀ", "1234 日本語のテキスト", "\t\n\v\f\r "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids_crc32 for r in pack_sequences(docs, WORD_VOCABULARY).collect()}
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    tokenizer.encode_special_tokens = True
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes()), text


def optimal(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        bound = lower_bound(np.array(sizes), 20)
        assert -(-sum(sizes) // 20) <= bound <= optimal(sizes, 20) <= best_fit(np.array(sizes), 20).max() + 1


def test_best_fit_takes_the_fullest_bin():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 400)
    room, n, want = [], 0, {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if not fits:
            room.append(100)
            fits = [(100, len(room) - 1)]
        least = min(fits)[0]
        k = next(k for r, k in fits if r == least)
        want[i] = least - sizes[i]
        room[k] -= sizes[i]
    for method in (best_fit, best_fit_decreasing):
        bins = method(sizes, 100)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 100 and sorted(100 - fill) == sorted(room)


def test_segment_tree_finds_the_least_room():
    rng, tree, held = random.Random(4), FreeRoom(50), []
    for row in range(400):
        if held and rng.random() < 0.5:
            size = rng.randint(1, 50)
            fits = sorted(r for r, _ in held if r >= size)
            found = tree.take(size)
            assert (found[0] if found else None) == (fits[0] if fits else None)
            if found:
                held.remove(found)
        else:
            room = rng.randint(1, 50)
            tree.add(room, row)
            held.append((room, row))


def test_packed_rows_join_to_the_same_ids(docs, odd):
    import tiktoken
    from fleetlens.llm.tokens import Vocabulary

    coder = Vocabulary(BYTE_VOCABULARY)
    assert tiktoken
    for table in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = packed_rows(table, BYTE_VOCABULARY, BYTE_END, part_bytes=200_000).collect()
        pieces = {}
        for r in rows:
            line, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(line) == len(at) == 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
            assert (line[r.n_tokens :] == BYTE_END).all()
            for (d, p, ids), a, b in zip(unpacked(r.asDict(), 2), r.cu_seqlens, r.cu_seqlens[1:]):
                pieces[d, p] = ids.tolist()
                assert at[a:b].tolist() == list(range(b - a))
        for r in table.select("doc_id", "text").collect():
            want = coder.encode([r.text or ""])[0] + [BYTE_END]
            assert sum((pieces[r.doc_id, i] for i in range(-(-len(want) // 2048))), []) == want
        assert len({r.sequence_id for r in rows}) == len(rows)


def test_odd_rows_and_empty_tables(odd, empty):
    rows = pack_sequences(odd, WORD_VOCABULARY).collect()
    check_places(rows)
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert pack_sequences(empty, WORD_VOCABULARY).count() == packed_rows(empty, BYTE_VOCABULARY, BYTE_END).count() == 0
