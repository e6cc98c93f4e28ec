"""What several test modules use: odd rows, rows with near copies, brute force and checks of results."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from fleetlens.llm.queries import WORD_VOCABULARY

SMALL = "/root/testdata/sf0.001"

#: Rows every operator has to take: nulls, empty and long texts, repeated rows, extra columns with names the operators use.
ODD = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (None, "no id here but some words to keep it going on and on", "en", "s", 3),
    (3, "same row twice " * 20, "en", "s", 3),
    (3, "same row twice " * 20, "en", "s", 3),
    (4, "1 2 3 ... !!!", "de", "s", 3),
    (5, "long text with many words and no end " * 20_000, "en", "s", 3),
    (6, "é" * 500, "fr", None, 3),
    (None, None, None, None, None),
]


def brute_repeats(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def near_rows(spark, docs):
    rng = random.Random(5)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    long = [t for t in texts if len(t[1].split()) > 150][:12]
    copies = []
    for k, (_, text) in enumerate(long):
        for j in range(5):
            words = text.split(" ")
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = "changed"
            copies.append((10_000 + 10 * k + j, " ".join(words)))
        copies.append((20_000 + k, text))
    return spark.createDataFrame(texts + copies, "doc_id bigint, text string").repartition(4)


def ids_of(text):
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == list(itertools.accumulate([0] + [n for _, n in places]))[:-1]
        assert sum(n for _, n in places) <= capacity
    return len(by)
