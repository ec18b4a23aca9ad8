import hashlib
import random
from collections import Counter

import pytest

from geoladder.llm import span_dedup as sd


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(20) for _ in range(4)]
    out = ["", None, "x", "z" * 90, prose(60)]
    for _ in range(40):
        parts = [prose(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            if r.random() < 0.4:
                i = r.randrange(len(s))
                s = s[:i] + "#" + s[i + 1 :]
            parts += [s[r.randint(0, 15) :], prose(r.randint(0, 12))]
        out.append(" ".join(parts))
    out += [out[10], out[10], out[11] + "!", "ab" * 100]
    return out


@pytest.mark.parametrize("seed,length,gram,most", [(1, 40, 12, 20000), (2, 40, 12, 3), (3, 60, 60, 20000), (4, 33, 9, 2)])
def test_against_brute_force(spark, seed, length, gram, most):
    t = texts(seed)
    df = spark.createDataFrame([(i if i % 7 else None, x, 1) for i, x in enumerate(t)], "doc_id bigint, text string, runs int")
    got = sorted(tuple(x) for x in sd.remove_repeats(df, spark, length, gram, most).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute(t, length))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.remove_repeats(df, spark).count() == 0


def test_whole_length_and_texts_made_by_halves(spark):
    """400 bytes, as registered; and words that hashes modulo a power of two take for each other."""
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b = letters(700), letters(399)
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    t = [letters(300) + a + letters(90), a[150:] + letters(50), b + "x" + letters(100), letters(80) + b + "y", word, word.translate({97: 98, 98: 97}), letters(200_000) + a, "q" * 900, None]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")
    got = sorted(tuple(x) for x in sd.remove_repeats(df, spark).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted(brute(t, 400))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    import numpy as np

    buf = np.frombuffer(b"aaaabbbbaaaaccccbbbbdddd", np.uint8)
    want = [set(c) for c in ((0, 2), (1, 4))]
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(sd._vec.Rolling, "__call__", lambda self, a, b: np.zeros(len(a), np.uint64))
        index, cls = sd.radix_groups(buf, np.arange(6) * 4, np.zeros(6, np.int64), 4)
        assert sorted(({int(i) for i in index[cls == c]} for c in np.unique(cls)), key=min) == want
