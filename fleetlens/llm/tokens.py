"""Public vocabularies behind one interface, and a coder that asks them once per word."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np

from fleetlens.llm.names import blocks, bounds, span_names

MAX_CACHED_WORDS = 1 << 20

_TEXTS = 32
_PUNCTUATION = ".,!?;:"


class Vocabulary:
    """A vocabulary file, by its suffix: .json (tokenizers), .tiktoken (ranks), .model (sentencepiece)."""

    def __init__(self, path: str):
        self.path = path
        self.splits_words = False
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(path)
            self._tokenizer.encode_special_tokens = True
            self.size = self._tokenizer.get_vocab_size()
            self.splits_words = self._splits_words()
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._ranks = ranks
            self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
        else:
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self._pieces.vocab_size()

    def _splits_words(self) -> bool:
        """Whether letters are lower-cased and parted from white space and punctuation before anything is merged."""
        parts = json.loads(self._tokenizer.to_str())
        normalizers, splits = json.dumps(parts["normalizer"]), json.dumps(parts["pre_tokenizer"], ensure_ascii=False)
        return '"Lowercase"' in normalizers and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splits

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.path.endswith(".json"):
            return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.path.endswith(".tiktoken"):
            return [self._encoding.encode_ordinary(t) for t in texts]
        return self._pieces.encode(texts, num_threads=1)

    def fallback(self) -> np.ndarray:
        """Which ids stand for a part of a character only, or for nothing known."""
        flags = np.zeros(self.size, bool)
        if self.path.endswith(".tiktoken"):
            for token, rank in self._ranks.items():
                try:
                    token.decode()
                except UnicodeDecodeError:
                    flags[rank] = True
        elif self.path.endswith(".model"):
            for i in range(self.size):
                flags[i] = self._pieces.is_byte(i) or self._pieces.is_unknown(i)
        return flags


class WordCoder:
    """Ids of texts word by word (between ASCII white space), each different word encoded once while it is held.

    For a vocabulary that drops white space the ids are those of the whole text. At most ``most`` words, and those of one call, are held.
    Where the vocabulary lower-cases words and splits them from punctuation (``splits_words``), words of Latin letters that differ in that only
    are encoded once too.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = MAX_CACHED_WORDS):
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self._index: dict[bytes, int] = {}
        self._parts: dict[str, list[int]] = {}
        self._flat = np.zeros(1 << 16, np.int32)
        self._ends = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _coded(self, words: list[str]) -> list[list[int]]:
        if not self.vocabulary.splits_words:
            return self.vocabulary.encode(words)
        cuts, parts = [], self._parts
        for word in words:
            core = word.rstrip(_PUNCTUATION)
            simple = core and core.isalpha() and max(core) < "\u0100"
            cuts.append((core.lower(), word[len(core) :]) if simple else (word, ""))
        new = [p for p in dict.fromkeys(p for cut in cuts for p in cut) if p not in parts]
        parts.update(zip(new, self.vocabulary.encode(new)))
        return [parts[core] + parts[rest] if rest else parts[core] for core, rest in cuts]

    def _learn(self, words: Iterable[bytes]) -> None:
        index = self._index
        new = list(dict.fromkeys(w for w in words if w not in index))
        coded = self._coded([w.decode() for w in new])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        at, end = len(index), self._used + int(sizes.sum())
        while end > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        while at + len(new) > len(self._ends):
            self._ends = np.concatenate((self._ends, np.zeros_like(self._ends)))
        self._flat[self._used : end] = np.fromiter(chain.from_iterable(coded), np.int32, end - self._used)
        self._ends[at : at + len(new)] = self._used + np.cumsum(sizes)
        self._used = end
        index.update(zip(new, range(at, at + len(new))))

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and how many each of its words has."""
        for a in range(0, len(texts), _TEXTS):
            if len(self._index) > self.most:
                self._clear()
            split = [t.split() for t in texts[a : a + _TEXTS]]
            counts = list(map(len, split))
            words = list(chain.from_iterable(split))
            at = np.fromiter(map(self._index.get, words, repeat(-1)), np.int64, len(words))
            missing = np.flatnonzero(at < 0).tolist()
            if missing:
                unknown = [words[i] for i in missing]
                self._learn(unknown)
                at[missing] = np.fromiter(map(self._index.__getitem__, unknown), np.int64, len(unknown))
            starts = np.where(at > 0, self._ends[at - 1], 0)
            sizes = self._ends[at] - starts
            before = np.cumsum(sizes) - sizes
            ids = self._flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
            word, token = 0, 0
            for count in counts:
                own = sizes[word : word + count]
                n = int(own.sum())
                yield ids[token : token + n], own
                word, token = word + count, token + n


# Bytes by what the pre-tokenizer of such a vocabulary makes of them: white space, letters, single digits, runs of other signs. Words that hold
# anything else (an apostrophe, a control character, a letter beyond Latin-1) are left to the library as they are.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[ord("'"), ord("<")]] = _ODD
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_LATIN_LEAD, _LATIN_TAILS, _LATIN_CAPITALS = 0xC3, np.zeros(256, bool), np.zeros(256, bool)
_LATIN_TAILS[0x80:0xC0] = True
_LATIN_TAILS[[0x97, 0xB7]] = False  # the multiplication and division signs
_LATIN_CAPITALS[0x80:0x9F] = True
_LATIN_CAPITALS[0x97] = False
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def pieces_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start and end of the pieces that the vocabulary splits them into before it merges anything."""
    data, kind = _ASCII_LOWER[raw], _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN_LEAD)
    lead = lead[_LATIN_TAILS[raw[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    capital = lead[_LATIN_CAPITALS[raw[lead + 1]]] + 1
    data[capital] += 0x20
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        starts, ends = bounds(kind != _SPACE)
        whole = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        change = np.zeros(len(raw) + 1, np.int8)
        change[starts[whole]] += 1
        change[ends[whole]] -= 1
        kind[np.cumsum(change[:-1]).astype(bool)] = _ODD
    same = (kind[1:] == kind[:-1]) & (kind[1:] != _DIGIT)
    held = kind != _SPACE
    begins, ends = held.copy(), held.copy()
    begins[1:] &= ~same
    ends[:-1] &= ~same
    return data, np.flatnonzero(begins), np.flatnonzero(ends) + 1


class PieceCoder:
    """Ids of texts piece by piece, for vocabularies that drop white space, lower-case and split words (``splits_words``).

    Pieces are told apart by 64-bit names. A sorted table holds the ids of those seen, at most ``most`` and those of one block of texts; the
    library is asked once for each that isn't there. There is no Python object for a piece that is known.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = MAX_CACHED_WORDS):
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self._names, self._begin, self._count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat, self._used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, names: np.ndarray, pieces: list[str]) -> None:
        coded = self.vocabulary.encode(pieces)
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        begin, end = self._used + np.cumsum(counts) - counts, self._used + int(counts.sum())
        while end > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        self._flat[self._used : end] = np.fromiter(chain.from_iterable(coded), np.int32, end - self._used)
        self._used = end
        at = np.searchsorted(self._names, names)
        self._names, self._begin, self._count = (
            np.insert(old, at, new) for old, new in ((self._names, names), (self._begin, begin), (self._count, counts))
        )

    def encode_all(self, values: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, raw, text_ends in blocks(values):
            if len(self._names) > self.most:
                self._clear()
            data, starts, ends = pieces_of(raw)
            names, first, of = np.unique(span_names(data, starts, ends), return_index=True, return_inverse=True)
            known = np.searchsorted(self._names, names)
            missing = np.append(self._names, np.uint64(0))[known] != names
            missing |= known == len(self._names)
            if missing.any():
                at = first[missing]
                self._learn(names[missing], [data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                known = np.searchsorted(self._names, names)
            begin, count = self._begin[known][of], self._count[known][of]
            total = np.cumsum(count)
            ids = self._flat[np.repeat(begin - total + count, count) + np.arange(int(total[-1]) if len(total) else 0)]
            upto = np.append(0, total)[np.searchsorted(starts, text_ends)]
            for a, b in zip(np.append(0, upto[:-1]).tolist(), upto.tolist()):
                yield ids[a:b]


_coders: dict[tuple[str, int], WordCoder] = {}


def word_coder(path: str, most: int = MAX_CACHED_WORDS) -> WordCoder:
    """The coder of this process for a vocabulary file."""
    if (path, most) not in _coders:
        _coders[path, most] = WordCoder(Vocabulary(path), most)
    return _coders[path, most]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


_piece_coders: dict[str, PieceCoder | WordCoder] = {}


def text_ids(path: str, values: list[bytes]) -> Iterator[np.ndarray]:
    """The ids of each text under a vocabulary that drops white space, with what this process has coded before."""
    if path not in _piece_coders:
        held = vocabulary(path)
        _piece_coders[path] = PieceCoder(held) if held.splits_words else WordCoder(held)
    coder = _piece_coders[path]
    if isinstance(coder, PieceCoder):
        yield from coder.encode_all(values)
    else:
        yield from (ids for ids, _ in coder.encode_all(values))
