import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoladder.llm import ngram_trie as nt

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, order):
    toks = [(d, [*((t or "").encode().translate(LOW).split()), None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in toks]
    uni = Counter(w for (_, t), h in zip(toks, held) if not h for w in t)
    n, v = sum(uni.values()), len(uni)
    grams = {k: Counter() for k in range(2, order + 1)}
    for (_, t), h in zip(toks, held):
        if not h:
            s = [None, *t]
            for k in grams:
                for i in range(len(s) - k + 1):
                    grams[k][tuple(s[i : i + k])] += 1
    cuts, sums, offs = {}, defaultdict(Counter), defaultdict(Counter)
    for k, g in grams.items():
        cc = Counter(g.values())
        cuts[k] = nt.discounts(cc[1], cc[2], cc[3], cc[4])
        for x, c in g.items():
            sums[k][x[:-1]] += c
            offs[k][x[:-1]] += cuts[k][min(c, 3) - 1]

    def base(w):
        return math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))

    def p(x):
        k = len(x)
        if k == 1:
            return 10 ** base(x[0])
        total = sums[k][x[:-1]]
        if not total:
            return p(x[1:])
        c = grams[k][x]
        own = (c - cuts[k][min(c, 3) - 1]) / total if c else 0
        return own + offs[k][x[:-1]] / total * p(x[1:])

    out = []
    for (d, t), h in zip(toks, held):
        s = [None, *t]
        sc = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i + 1]))) for i in range(1, len(s)))
        out.append((d, h, len(t), sum(uni[w] > 0 for w in t), n, sum(base(w) for w in t), sc))
    return out


def made(n, seed=0):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["Éa", "éA", "B c"]
    out = [(None, "A b"), (3, None), (4, ""), (5, "  \t\x0b "), (6, "one"), (6, "one")]
    for i in range(n):
        a = [words[min(int(r.expovariate(0.08)), len(words) - 1)] for _ in range(r.randint(1, 40))]
        out.append((i + 10, r.choice(["  ", "\n", " "]).join(x.upper() if r.random() < 0.3 else x for x in a)))
    return out + [(9000, "w1 " * 500), (9001, "w1 w2 " * 50)]


@pytest.mark.parametrize("order,shard", [(2, 500), (3, 700), (3, 1 << 24)])
def test_against_brute_force(spark, order, shard):
    rows = made(120)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, score int")
    got = sorted((tuple(x) for x in nt.score_corpus(df, spark, order, shard).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    want = sorted(brute(rows, order), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) <= g[2] * 0.05 + 1e-6, (g, w)  # quantised
    assert abs(sum(g[6] for g in got) - sum(w[6] for w in want)) < 0.01 * abs(sum(w[6] for w in want))


def test_kept_model(spark):
    """A model that is kept gives other texts the scores that one run over both gives; common words span several shards."""
    rows = made(80, 3) + [(9100 + i, "w1 " + "w%d w1 " % i) for i in range(60)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    schema = "doc_id bigint, text string"
    model = nt.train(spark.createDataFrame([x for x in rows if not held(x[0])], schema), spark, 3, 200)
    assert len({s for s, u in model.uri.items() if u}) > 8
    df = spark.createDataFrame(rows, schema).withColumn("held_out", nt.held_out(F.col("doc_id")))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got, want = sorted(map(tuple, nt.score(df, model, spark).collect()), key=key), sorted(brute(rows, 3), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[6] - w[6]) <= g[2] * 0.05 + 1e-6 for g, w in zip(got, want))


def test_no_training_rows(spark):
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = nt.score_corpus(spark.createDataFrame([(d, "a b")], "doc_id bigint, text string"), spark).collect()
    assert [tuple(x) for x in got] == [(d, True, 3, 0, 0, 0.0, 0.0)]
    assert nt.score_corpus(spark.createDataFrame([], "doc_id bigint, text string"), spark).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((1, 1), (5, 5), (1000, 1000), (3000, 10**9), (2000, 5000), (1, 1 << 40)):
        v = np.sort(r.choice(u, n, replace=False) if u < 10**7 else np.unique(r.integers(0, u, n))).astype(np.int64)
        head, parts = nt.ef_bytes(v, u)
        a = [np.frombuffer(x, np.uint8) for x in parts]
        e = nt.EliasFano(head["n"], head["width"], a[0], nt.Bits(a[1].view("<u8"), a[2].view(head["kind"]), a[3].view(head["kind"])))
        assert e.get(np.arange(len(v))).tolist() == v.tolist()
        if len(v) > 1:
            a, b = e.pair(np.arange(len(v) - 1))
            assert a.tolist() == v[:-1].tolist() and b.tolist() == v[1:].tolist()
        x = np.concatenate([v, r.integers(0, u, 500)])
        i = e.search(x, np.zeros(len(x), np.int64), np.full(len(x), len(v)))
        assert (i >= 0).tolist() == np.isin(x, v).tolist() and (v[i[i >= 0]] == x[i >= 0]).all()
        k = len(v) // 2
        assert (e.search(v, np.full(len(v), k), np.full(len(v), len(v))) >= 0).tolist() == [j >= k for j in range(len(v))]
