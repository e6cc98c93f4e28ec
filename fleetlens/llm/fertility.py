"""Quality rules from tokeniser fertility: how well public vocabularies fit a text.

For each vocabulary a text has its characters per token, its share of fallback tokens (tokens for parts of a character)
and the entropy of its tokens relative to their number. Texts are judged among those of their language, or their script if they name none,
and of their length, by powers of two: the quartiles of each measure over all documents of that group that pass the plain
rules give bands, ``reach`` times the interquartile range beyond the quartiles, and wider in groups of few texts. Texts outside are rejected.
A group of fewer than ``LEAST_TEXTS`` texts says nothing about its own: they are judged by the band of their language over all lengths, if that
is as thin of their script, else of all texts; and by the mean entropy of blocks of fixed size, as that of whole texts falls with their length.

Words are tokenised one by one, so a task asks a vocabulary once for each different word it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.names import _SPACE, blocks, combined, small, texts, word_names
from fleetlens.llm.tokens import vocabulary, word_coder
from fleetlens.plans.shared import stored

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REACH = 3.5
FEW_TEXTS = 10
LEAST_TEXTS = 20
BLOCK_TOKENS = MIN_WORDS
CACHED_WORDS = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Scripts by the first byte of a letter.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_SCRIPT = np.zeros(256, np.int64)
for _name, _first, _last in (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xC9), ("other", 0xCA, 0xCD), ("greek", 0xCE, 0xCF), ("cyrillic", 0xD0, 0xD4),
    ("other", 0xD5, 0xD6), ("hebrew", 0xD7, 0xD7), ("arabic", 0xD8, 0xDB), ("other", 0xDC, 0xDF), ("indic", 0xE0, 0xE0),
    ("other", 0xE1, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("other", 0xEE, 0xF4),
):
    _SCRIPT[_first : _last + 1] = SCRIPTS.index(_name)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    seen = set(lines)
    if len(seen) == len(lines):
        return 0
    worded = sum(1 for line in lines if line.split())
    return worded - sum(1 for line in seen if line.split())


def plain_measures(values: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words, script of each text."""
    out = {name: np.zeros(len(values), np.int64) for name in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "script")}
    for first, data, ends in blocks(values):
        begins, n = np.concatenate(([0], ends[:-1])), len(ends)
        starts, _, names = word_names(data)
        of = np.searchsorted(ends, starts, side="right")
        rows = slice(first, first + n)
        out["n_words"][rows] = np.bincount(of, minlength=n)
        out["word_chars"][rows] = np.add.reduceat(((data & 0xC0) != 0x80) & ~_SPACE[data], begins, dtype=np.int64)
        out["n_symbols"][rows] = np.add.reduceat(_SYMBOL[data], begins, dtype=np.int64)
        windows = combined(names, 3)
        at = np.flatnonzero(of[: len(windows)] == of[2:][: len(windows)])
        order = at[np.lexsort((windows[at], of[at]))]
        same = (windows[order][1:] == windows[order][:-1]) & (of[order][1:] == of[order][:-1])
        twice = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        covered = np.zeros(len(starts), bool)
        for i in range(3):
            covered[twice + i] = True
        out["n_repeat_words"][rows] = np.bincount(of[covered], minlength=n)
        letters = np.flatnonzero(_SCRIPT[data])
        by_script = np.bincount(np.searchsorted(ends, letters, side="right") * len(SCRIPTS) + _SCRIPT[data[letters]], minlength=n * len(SCRIPTS))
        out["script"][rows] = by_script.reshape(n, -1).argmax(1)
    return out


_SELF_LOG = np.append(0, np.arange(1, BLOCK_TOKENS + 1) * np.log(np.arange(1, BLOCK_TOKENS + 1)))


def block_entropies(ids: list[np.ndarray]) -> np.ndarray:
    """Of each text the mean entropy of its blocks of tokens relative to their size; the last block ends with the text. Shorter texts have none."""
    size = BLOCK_TOKENS
    counts = np.array([len(i) for i in ids], np.int64)
    blocks_of = np.where(counts >= size, -(-counts // size), 0)
    of = np.repeat(np.arange(len(ids)), blocks_of)
    within = np.arange(len(of)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
    begins = (np.cumsum(counts) - counts)[of] + np.minimum(within * size, counts[of] - size)
    flat, repeated = np.concatenate([*ids, np.zeros(size, np.int32)]), np.zeros(len(of))
    windows = np.lib.stride_tricks.sliding_window_view(flat, size)
    for a in range(0, len(of), 1 << 13):
        part = np.sort(windows[begins[a : a + (1 << 13)]], axis=1)
        changes = np.ones(part.shape, bool)
        np.not_equal(part[:, 1:], part[:, :-1], out=changes[:, 1:])
        first = np.flatnonzero(changes)
        runs = np.diff(np.append(first, part.size))
        several = np.flatnonzero(runs > 1)
        repeated[a : a + len(part)] = np.bincount(first[several] // size, weights=_SELF_LOG[runs[several]], minlength=len(part))
    total = np.bincount(of, weights=repeated, minlength=len(ids))
    return np.where(blocks_of > 0, 1 - total / (np.maximum(blocks_of, 1) * size * np.log(size)), np.nan)


def _coded(path: str, values: list[bytes]) -> list[np.ndarray]:
    """Ids of whole texts. Only vocabularies that see no difference are asked word by word: in a byte vocabulary, white space belongs to tokens."""
    if path.endswith(".tiktoken"):
        return [np.array(ids, np.int32) for ids in vocabulary(path).encode([v.decode() for v in values])]
    return [ids for ids, _ in word_coder(path, CACHED_WORDS).encode_all(values)]


def _measures(batches: Iterator[pa.RecordBatch], paths: list[str]) -> Iterator[pa.RecordBatch]:
    fallback = [vocabulary(p).fallback() for p in paths]
    for batch in small(batches):
        values = list(texts(batch))
        plain = plain_measures(values)
        fit = [[], [], [], []]
        coded_texts = [_coded(p, values) for p in paths]
        by_block = [block_entropies(ids).tolist() for ids in coded_texts]
        for i, (chars, *coded) in enumerate(zip(plain["word_chars"].tolist(), *coded_texts)):
            row = ([], [], [], [])
            for ids, parts, entropies in zip(coded, fallback, by_block):
                n = len(ids)
                if n:
                    share = np.unique(ids, return_counts=True)[1] / n
                    row[0].append(chars / n)
                    row[1].append(float(parts[ids].mean()))
                    row[2].append(float(-(share * np.log(share)).sum() / np.log(n)) if n > 1 else 1.0)
                    row[3].append(entropies[i] if n >= BLOCK_TOKENS else row[2][-1])
            for column, value in zip(fit, row):
                column.append(value or None)
        counts = [pa.array(plain[c]) for c in ("n_words", "word_chars", "n_symbols")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), batch.column("lang"), *counts, pa.array(map(repeated_lines, values), pa.int64()), pa.array(plain["n_repeat_words"]),
             pa.array([SCRIPTS[i] for i in plain["script"]]), *(pa.array(c, pa.list_(pa.float64())) for c in fit)],
            ["d", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "chars_per_token", "fallback_share", "token_entropy",
             "block_entropy"],
        )


_MEASURES = (
    "d bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, script string, "
    "chars_per_token array<double>, fallback_share array<double>, token_entropy array<double>, block_entropy array<double>"
)

#: The least interquartile range of each measure, so that groups of like texts don't reject each other.
LEAST_RANGE = {"chars_per_token": 0.02, "fallback_share": 0.005, "token_entropy": 0.01, "block_entropy": 0.01}


def fertility(
    docs: DataFrame, tokenizer_paths: list[str], id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", reach: float = REACH
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, band_group and the three measures.

    Measures are arrays, one value per vocabulary. A text that is null or has no words has zeros, null measures, and fails the plain rules.
    A band's reach grows with 1 + FEW_TEXTS / texts in the group; band_group names the group whose band judged a text: language and length class, its
    language, its script, or "all". Null and repeated ids are rows like any other; other
    columns are ignored.
    """
    read = docs.select(F.col(id_column).cast("long").alias("d"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    measured = read.mapInArrow(lambda b: _measures(b, tokenizer_paths), _MEASURES)
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"
    measured = measured.withColumn("base_failed", F.expr(failed))
    language = F.coalesce("lang", "script")
    length = F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("string")
    measured = stored(measured.withColumn("language", language).withColumn("length", length), "fertility")
    quartiles, outside = [], []
    for k in range(len(tokenizer_paths)):
        for name, least in LEAST_RANGE.items():
            band = f"{name}_{k}"
            quartiles.append(F.percentile_approx(F.col(name)[k], [0.25, 0.75], 10_000).alias(band))
            value, low, high = f"{name}[{k}]", f"band.{band}[0]", f"band.{band}[1]"
            span = f"{reach} * (1 + {FEW_TEXTS} / band.group_texts) * greatest({high} - {low}, {least})"
            by = {"token_entropy": "band.level = 0 AND ", "block_entropy": "band.level > 0 AND "}.get(name, "")
            if name not in ("token_entropy", "block_entropy"):
                outside.append(f"{value} > {high} + {span}")
            if name != "fallback_share":
                outside.append(f"({by}{value} < {low} - {span})")
    groups = [F.concat_ws("/", "language", "length"), F.col("language"), F.col("script"), F.lit("all")]
    levels = F.array(*(F.struct(F.lit(i).alias("level"), g.alias("band_group")) for i, g in enumerate(groups)))
    kinds = ["language", "length", "script"]
    leveled = measured.where("NOT base_failed").withColumn("group", F.explode(levels)).select("group.*", *kinds, *LEAST_RANGE)
    bands = leveled.groupBy("level", "band_group").agg(F.count(F.lit(1)).alias("group_texts"), *quartiles)
    # each kind of text is judged by the first of its groups that has enough texts; there are few kinds
    asked = leveled.select("level", "band_group", *kinds).distinct().join(bands, ["level", "band_group"]).where(f"level = 3 OR group_texts >= {LEAST_TEXTS}")
    chosen = asked.groupBy(*kinds).agg(F.min_by(F.struct("level", "band_group", "group_texts", *(c for c in bands.columns[3:])), "level").alias("band"))
    judged = measured.join(chosen, kinds, "left").withColumn("kept", F.expr(f"NOT base_failed AND NOT coalesce({' OR '.join(outside)}, false)"))
    judged = judged.withColumn("band_group", F.coalesce("band.band_group", groups[0]))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band_group"]
    return judged.select(F.col("d").alias(id_column), *columns, "chars_per_token", "fallback_share", "token_entropy")
