import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoladder.llm import chat_format as cf
from geoladder.llm import decontaminate as de
from geoladder.llm import mixing, quality, topk
from geoladder.llm import warc_index as wi

# ------------------------------------------------------------------------------------------------------------- WARC


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(wi.LoserTree(runs, lambda x: x)) == sorted(x for q in runs for x in q)


def test_url_key():
    assert wi.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1" and wi.url_key("http://x.org:8080") == "org,x:8080)/"
    assert wi.url_key(None) == "" and wi.url_key("no host") == "no host"


def test_warc(spark):
    rows = [(1, "http://a.com/x", "same"), (7, "http://b.com/y\r\nX: 1", "same"), (7, "http://b.com/y\r\nX: 1", "same"), (3, None, None), (4, "http://a.com/x", ""), (None, "u", "lone"), (None, "u", "same"), (9, "http://a.com/é?q= 1", "é" * 70000), (-5, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, digest string")
    got = wi.capture_index(df, spark).collect()
    key = lambda r: (r.urlkey.encode(), r.timestamp, r.page_id is not None, r.page_id or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    best = defaultdict(list)
    for p, _, h in rows:
        best[h or ""].append(p)
    want = []
    for p, _, h in rows:
        h = h or ""
        top = max((x for x in best[h] if x is not None), default=None)
        want.append((p, len(h.encode()), wi.base32_sha1(h.encode()), "response" if p == top else "revisit", None if p == top else top))
    norm = lambda t: tuple(str(x) for x in t)
    assert sorted(norm((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(norm, want))
    assert {r.record_type for r in wi.capture_index(df, spark, min_bytes=5).where("payload_bytes < 5").collect()} == {"response"}
    assert wi.capture_index(df.limit(0), spark).count() == 0


def test_warc_order_by_timestamp(spark, monkeypatch):
    """Many small runs and ranges: one URL's captures lie in many of both."""
    monkeypatch.setattr(wi, "RANGE_ENTRIES", 37)
    r = random.Random(9)
    rows = [(i, r.choice(["http://hot.com/", "http://hot.com/", f"http://h{i % 7}.org/p"]), f"body {i}", f"20{r.randint(10, 24)}-0{r.randint(1, 9)}-11 0{r.randint(0, 9)}:00:00" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").repartition(9)
    got = [(x.urlkey, x.timestamp, x.page_id) for x in wi.capture_index(df, spark, timestamp=F.col("at").cast("timestamp")).collect()]
    want = sorted((wi.url_key(u), wi.EPOCH if t is None else t.replace(" ", "T") + "Z", i) for i, u, _, t in rows)
    assert got == want


# ------------------------------------------------------------------------------------------------------------- chat

HARD = ["", "plain", "###", r"\###", r"\\### x", "</turn>", "a\n</turn>\nb", "x\n</turn>", "### user: y", "\\", "tail\\", ": ", "a: b", "\n", "\n</turn>\n\n</turn>\n", r"\### Assistant: </turn> ok", "é" * 5000]


def test_chat_round_trip(spark):
    rows = [(i // 4, i % 4, ["user", "assistant", None, "sys: \\tem\n</turn>\n### "][(i + i // 4) % 4], t) for i, t in enumerate(HARD * 4)] + [(None, None, "assistant", None), (99, 1, "assistant", "a"), (99, 1, "assistant", "a"), (99, None, "user", "first")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, output int")
    got = {r.conv_id: r for r in cf.digest(cf.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, n, role, t in rows:
        by[c].append(((n is not None, n or 0), role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    plain = cf.format_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo ###")], "conv_id bigint, turn bigint, role string, text string")).first()
    assert not plain.escaped and plain.output == "### user: hi\n</turn>\n### assistant: yo ###\n</turn>\n"
    assert cf.digest(cf.format_conversations(df.limit(0))).count() == 0


# ------------------------------------------------------------------------------------------------------------ mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, out, live = float(sum(sizes.values())), {}, set(names)
    while live:
        total = sum(w[n] for n in live)
        full = [n for n in live if left * w[n] / total > most * sizes[n]]
        if not full:
            return out | {n: left * w[n] / total for n in live}
        for n in full:
            out[n] = most * sizes[n]
            live.discard(n)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("per_bucket", [64, 3])
def test_mixing(spark, per_bucket):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 20), r.choice(["a", "a", "a", "B", "é", None, "tiny" if i % 40 == 0 else "b"])) for i in range(300)] + [(None, "x y z", "a"), (5, None, "b")] + [(1000, "q q q", "a")] * 6
    rows += [(2000, " ".join(f"v{j}" for j in range(3000)), "B"), (None, None, None), (None, "", "é")] + [(1001, " s\tt ", "é")] * 40
    df = spark.createDataFrame([(*x, i % 3) for i, x in enumerate(rows)], "doc_id bigint, text string, source string, __doc int")
    got = mixing.allocate(df, spark, rows_per_bucket=per_bucket).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(sizes), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert sorted(str((x.doc_id, x.size, x.source)) for x in got) == sorted(str((i, size(t), s)) for i, t, s in rows)
    assert all(0 <= want[s] - taken[s] < 1 + 1e-6 for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    # a pass begins only when all others have had as many, but for one entry per source that is cut
    cut = Counter(x.source for x in got if x.part)
    assert max(cut.values(), default=0) <= 1
    again = mixing.allocate(df, spark, rows_per_bucket=per_bucket).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(df, spark, rows_per_bucket=per_bucket)
    assert mixed.columns == df.columns
    out = mixed.collect()
    words, whole = Counter(), {(i, s): t for i, t, s in rows}
    for x in out:
        words[x.source] += size(x.text)
        assert whole[x.doc_id, x.source].startswith(x.text)
    assert words == +taken and sorted(map(str, out)) == sorted(map(str, mixing.mix(df, spark, rows_per_bucket=per_bucket).collect()))
    assert sum(x.text != whole[x.doc_id, x.source] for x in out) == sum(x.part > 0 for x in got)
    assert mixing.allocate(df.limit(0), spark).count() == 0 and mixing.mix(df.limit(0), spark).count() == 0


def test_mixing_against_brute_force(spark):
    """The queue served in one list: passes in order of virtual finish, each source cut at its target."""
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 5, 30, 400]))), r.choice("abcd")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    keys = {x.doc_id: (x.shuffled, x.text_key) for x in df.select("doc_id", F.xxhash64("text").alias("text_key"), F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.xxhash64(F.col("source").isNull(), "source"), F.lit(17)), 1).alias("shuffled")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets(sizes), Counter()
    for s in sizes:
        left = int(want[s])
        for _ in range(3):
            for i, t, _s in sorted((x for x in rows if x[2] == s), key=lambda x: keys[x[0]]):
                n = min(left, len(t.split()))
                taken[i] += n
                left -= n
    assert {x.doc_id: x.taken for x in mixing.allocate(df, spark, rows_per_bucket=5).collect()} == {i: taken[i] for i, _, _ in rows}


# ------------------------------------------------------------------------------------------------------------- top-k


def test_topk(spark):
    r = np.random.default_rng(4)
    vec = [(i, [float(x) for x in np.where(r.random(8) < 0.3, 0, r.normal(size=8))]) for i in range(150)]
    vec += [(i, [0.5] * 8) for i in range(200, 240)] + [(300, None), (320, [float("nan")] * 8), (340, [None] * 8), (None, [1.0] * 8), (360, []), (380, [1e30, 1.0]), (7, [0.1] * 8), (20, vec[20][1])]
    df = spark.createDataFrame([(*v, 1) for v in vec], "vec_id bigint, embedding array<double>, rank int")
    v = topk.vectors_of(df)
    got = topk.search(v, v.where("vec_id % 20 = 0"), spark, k=20, candidate_rows=40, query_rows=3).collect()
    ok = [(i, [math.floor(64 * x) for x in e]) for i, e in vec if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, a in {(i, tuple(e)) for i, e in ok if i % 20 == 0}:
        scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i) for i, b in ok if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:20], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(v.limit(0), v.limit(0), spark).count() == 0


# --------------------------------------------------------------------------------------------------- decontamination


def test_decontamination(spark):
    r = random.Random(5)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [prose(n) for n in (40, 25, 12, 3, 60)]
    items[4] = (["again", "and", "once", "more", "now"] * 12)[:60]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(10, None), (11, " "), (None, "a b c d e f")]
    docs = [(0, None), (1, ""), (2, " ".join(prose(300)))]
    for i, t in enumerate(items):
        docs.append((100 + i, "\n".join(prose(r.randint(0, 50)) + [w.upper() for w in t] + prose(9))))
        changed = list(t)
        if len(t) > 20:
            changed[len(t) // 2] = "other"
            docs.append((200 + i, " ".join(prose(20) + changed + prose(20))))
            docs.append((300 + i, " ".join(t[3:])))
            docs.append((400 + i, " ".join(prose(5) + t[: len(t) // 2] + prose(30))))
    docs += [(100, docs[3][1]), (100, "clean text under the same id"), (None, docs[3][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(*x, "s") for x in bench], "item_id bigint, text string, start string")

    def bag(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()

    want = {}
    for did, t in docs:
        w = (t or "").lower().split()
        for iid, it in bench:
            iw = (it or "").lower().split()
            if iid is None or not iw:
                continue
            ib, best = bag(iw), 0.0
            for s in range(-len(iw) + 1, len(w)):
                wb = bag(w[max(s, 0) : max(s + len(iw), 0)])
                both = sum((wb & ib).values())
                best = max(best, both / (sum(wb.values()) + sum(ib.values()) - both))
            if best >= 0.8:
                want[did, iid] = max(best, want.get((did, iid), 0))
    for limit in (10**6, 0):
        got = {(x.doc_id, x.item_id): x.similarity for x in de.leaks(d, b, spark, broadcast_rows=limit).collect()}
        assert got == pytest.approx(want)
    kept = de.clean(d, b, spark)
    bad = {did for did, _ in want}
    assert kept.columns == d.columns
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(map(str, [did for did, t in docs if did not in bad] + [100]))
    assert de.leaks(d, b.limit(0), spark).count() == 0 and de.clean(d.limit(0), b, spark).count() == 0


def test_decontamination_cut_passages(spark):
    r = random.Random(7)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    t = prose(60)
    loop = [f"l{i % 20}" for i in range(60)]
    swapped = t[30:] + t[:30]
    long = prose(100)
    docs = [t[:50] + prose(100), prose(100) + t[10:], t[:52] + prose(100), t[:44] + prose(100), prose(30) + t[:50] + prose(70), t[5:53], loop[7:] + loop[:20] + prose(9), prose(4) + loop + loop[3:50], prose(20) + swapped + prose(10), prose(3) + long[50:] + long[:50] + prose(8), long[70:] + long[:70], prose(9) + t[:30] + prose(2) + t[30:] + prose(4), prose(30_000) + long]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, " ".join(t)), (2, " ".join(loop)), (3, " ".join(long))], "item_id bigint, text string")
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for i, w in enumerate(docs):
        for j, it in ((1, t), (2, loop), (3, long)):
            best, n = 0.0, len(it)
            for s in range(1 - n, len(w)) if len(w) < 9999 else range(len(w) - 2 * n, len(w)):
                both = sum((bag(w[max(s, 0) : s + n]) & bag(it)).values())
                best = max(best, both / (sum(bag(w[max(s, 0) : s + n]).values()) + n - 4 - both))
            if best >= 0.8:
                want[i, j] = best
    assert want[9, 3] > 0.9 and (10, 3) in want and (12, 3) in want and (0, 1) in want and (1, 1) in want and (3, 1) not in want and (4, 1) not in want and want[2, 1] > 0.85
    for limit in (10**6, 0):
        assert {(x.doc_id, x.item_id): x.similarity for x in de.leaks(d, b, spark, broadcast_rows=limit).collect()} == pytest.approx(want)
    assert {x.doc_id for x in de.clean(d, b, spark).collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_decontamination_items_without_id(spark):
    b = spark.createDataFrame([(None, "a b c d e f g"), (None, "h i j k l m n"), (1, "o p q r s t u")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "x a b c d e f g"), (2, "h i j k l m n y"), (3, "z o p q r s t u"), (4, "a b c h i j")], "doc_id bigint, text string")
    assert [x.doc_id for x in de.clean(d, b, spark).collect()] == [4]
    assert [(x.doc_id, x.item_id) for x in de.leaks(d, b, spark).collect()] == [(3, 1)]


# ----------------------------------------------------------------------------------------------------------- quality


def test_quality_held_out(spark):
    r = random.Random(6)
    good = [f"g{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        kind = r.choice([0, 1, 2, 2])
        w = [r.choice(good) for _ in range(r.randint(20, 80))]
        if kind == 0:
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), kind))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 0)))
    d = spark.createDataFrame([*docs, (None, None, 0), (901, "", 0)], "doc_id bigint, text string, expected_grade int").withColumnRenamed("expected_grade", "kind")
    l = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    kept = {x.doc_id for x in quality.select(d, l, spark).collect()}
    held = [(i, k) for i, _, k in docs if i % 3 == 0]
    assert sum((i in kept) == (k == 2) for i, k in held) / len(held) > 0.95
    model = quality.train(d, quality.ratings_of(l), spark)
    assert (np.diff(model.thresholds) >= 0).all()
    scored = quality.score(d, model, spark)
    assert scored.count() == 902 and scored.where("expected_grade < 0 or expected_grade > 2").count() == 0
    none = quality.train(d, quality.ratings_of(l.limit(0)), spark)
    assert quality.score(d, none, spark).where("tail_probability >= 0.5").count() == 902
    assert quality.select(d.limit(0), l, spark).count() == 0


def test_quality_against_brute_force():
    """The fit reaches the maximum of the penalised likelihood that a plain optimiser finds, and its gradient is zero there."""
    r = np.random.default_rng(3)
    n, dims = 400, quality.SHAPES + 4
    x = (r.random((n, 4)) < 0.5).astype(float)
    latent = x @ np.array([2.0, -1.5, 1.0, 0.0]) + r.logistic(size=n)
    grades = (latent > 0).astype(int) + (latent > 1.5)
    row, cell = np.nonzero(x)
    begin = np.searchsorted(row, np.arange(n + 1))
    m = quality.fit(cell, np.ones(len(cell)), begin, grades, dims, 3, steps=8000, rate=0.3, ridge=0.0, screen=0.0)
    share = np.bincount(grades, minlength=3) / n
    weight = (1 / np.sqrt(share))[grades]

    def loss(p):
        s, t1, t2 = x @ p[:4], p[4], p[4] + np.exp(p[5])
        tail = np.stack([np.ones(n), 1 / (1 + np.exp(t1 - s)), 1 / (1 + np.exp(t2 - s)), np.zeros(n)])
        return -(weight * np.log(np.maximum(tail[grades, range(n)] - tail[grades + 1, range(n)], 1e-12))).sum() / weight.sum()

    def gradient(p):
        return np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(6) * 1e-5])

    best = np.array([0, 0, 0, 0, -0.5, 0.0])
    for _ in range(4000):
        best = best - 0.8 * gradient(best)
    got = np.array([*m.weights[:4], m.thresholds[0], np.log(m.thresholds[1] - m.thresholds[0])])
    assert loss(got) < loss(best) + 2e-3 and np.abs(gradient(got)).max() < 0.03
    tails = m.tails(x @ m.weights[:4].astype(float))
    assert np.allclose(tails[:, 0], 1 / (1 + np.exp(m.thresholds[0] - x @ m.weights[:4]))) and (tails[:, 0] >= tails[:, 1]).all()


def test_quality_columns_and_long_texts(spark, monkeypatch):
    docs = [(i, ("good word%d " % (i % 7)) * 3 if i % 2 else "bad thing%d " % (i % 5), 0.123, "x") for i in range(80)]
    docs += [(100, "good " * 200_000 + " ".join(f"v{j}" for j in range(30_000)), 0.123, "x"), (101, None, 0.123, None), (None, "good", 0.123, "x"), (3, docs[3][1], 0.123, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, expected_grade double, __id string")
    labels = spark.createDataFrame([(i, int(i % 2 == 1), 0) for i in range(60)] + [(100, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(d, quality.ratings_of(labels), spark, most_cells=300)
    scored = quality.score(d, model, spark)
    assert scored.columns == [*d.columns, "expected_grade_", "tail_probability"]
    assert {x.expected_grade for x in scored.collect()} == {0.123}
    kept = quality.select(d, labels, spark)
    ids = sorted((x.doc_id for x in kept.collect()), key=str)
    assert kept.columns == scored.columns and 5 not in ids and ids.count(3) == 2 and 100 in ids and not {i for i in ids if i is not None and i < 60 and i % 2 == 0}
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted((x.doc_id for x in quality.select(d, labels, spark).collect()), key=str) == ids


def test_quality_sample_passes_the_heap_by(spark, monkeypatch):
    """The fit gets every rated row's cells, in order of ids, without the JVM of the driver collecting them."""
    r = random.Random(8)
    docs = [(i % 25, " ".join("w%d" % r.randrange(40) for _ in range(i % 9))) for i in range(40)] + [(50, None), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(20), 50]], "doc_id bigint, quality int, toxic int")
    seen, fit = [], quality.fit

    def collected(self):
        raise AssertionError("collected")

    monkeypatch.setattr(quality, "fit", lambda *a, **how: [seen.append(a), fit(*a, **how)][1])
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(type(d), name, collected)
    quality.train(d, quality.ratings_of(labels), spark)
    cell, value, begin, grades = seen[0][:4]
    got = [(cell[i:j].tolist(), value[i:j].tolist(), g) for i, j, g in zip(begin[:-1], begin[1:], grades, strict=True)]
    want = defaultdict(list)
    for i, t in docs:
        if i is not None and (i < 20 or i == 50):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            c, v, _ = quality.cells(raw, np.array([0, len(raw)]), quality.DIMS)
            want[i].append((c.tolist(), v.astype(np.float16).astype(np.float32).tolist(), 1 + i % 2))
    at = 0
    for i in sorted(want):  # rows of one id may come in any order
        assert sorted(got[at : at + len(want[i])]) == sorted(want[i])
        at += len(want[i])
    assert at == len(got) == len(grades)
    quality.train(d, quality.ratings_of(labels.limit(0)), spark)
    assert [len(x) for x in seen[1][:4]] == [0, 0, 1, 0]


def test_signs_around_words():
    def cells(*texts):
        raw = [t.encode() for t in texts]
        c, _, begin = quality.cells(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1 << 18)
        return [{int(x) for x in c[i:j] if x < (1 << 18) - quality.SHAPES} for i, j in zip(begin[:-1], begin[1:])]

    for n in (0, 1, 8, 9, 40, 5000):
        got = cells("Word it's", "*" * n + "word" + "!" * n + " it's", "=" * n, "(" * n + " word", "word it's")
        assert got[0] == got[1] == got[4] and len(got[0]) == 2 and not got[2] and len(got[3]) == 1 and got[3] < got[0]


# ---------------------------------------------------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp
    from geoladder.llm import token_codes

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = cp._shared.written(stage(spark, seen[-1], sf), spark, name)
        assert name == "tokens" or out.columns == docs.columns
        seen.append(out)
    n = [x.count() for x in seen]
    assert n[0] >= n[1] >= n[2] >= n[3] > 0
    text = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1 or quality = 0").collect()}
    assert not bad & {r.doc_id for r in seen[1].collect()}
    assert len({text[r.doc_id] for r in seen[2].collect()}) == n[2]
    assert not {r.doc_id for r in de.leaks(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet"), spark).collect()}
    shares = mixing.allocate(seen[3], spark).agg(F.sum("passes"), F.count_if(F.col("part") > 0)).first()
    assert n[4] == sum(shares) == n[5]
    with open(token_codes.default_vocabulary(), encoding="utf-8") as f:
        lib = token_codes.encoder(f.read()).lib
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids) + 1
    mixed = sorted(((r.doc_id, size(r.text)) for r in seen[4].collect()))
    at = 0
    for r in (rows := seen[5].orderBy("start").collect()):
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == mixed


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names, and empty tables."""
    import corpus_pipeline as cp

    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    item, twin = prose(40), prose(60)
    rows = [(i, prose(50), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, twin, "en", "s0", 1), (51, twin + " more", "en", "s1", 1), (52, "x " + item + " y", "en", "s0", 1), (60, None, None, None, None), (None, prose(30), "en", None, 2), (61, "", "en", "s2", 0)]
    rows += [(62, prose(40_000), "de", "s1", 3), rows[0], rows[0], (0, prose(50), "en", "s0", 1), (63, " \n", "en", "s0", 1)]
    names = "doc_id bigint, text string, lang string, source string, n_chars int"
    extra = [(*x, i, i, i) for i, x in enumerate(rows)]
    d = spark.createDataFrame(extra, names + ", __id int, __text int, tail_probability int")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 1), (31, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "zz yy xx"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(cp.STAGES)
    for table in (d,):
        marks = lambda df: sorted(map(str, df.collect()))
        out = stage["quality"](spark, table, str(tmp_path))
        assert out.columns == table.columns and 31 not in {x.doc_id for x in out.collect()} and set(marks(out)) <= set(marks(table))
        out = stage["near_dedup"](spark, table, str(tmp_path))
        assert out.columns == table.columns and set(marks(out)) <= set(marks(table))
        ids = Counter(x.doc_id for x in out.collect())
        assert 50 in ids and 51 not in ids and ids[0] == 2 and sum(i in ids for i in (60, 61, 63)) == 1 and None in ids
        out = stage["decontaminate"](spark, table, str(tmp_path))
        assert out.columns == table.columns and {x.doc_id for x in out.collect()} == {x[0] for x in rows} - {52} and out.count() == len(rows) - 1
        out = stage["mix"](spark, table, str(tmp_path))
        assert out.columns == table.columns and not {60, 61, 63} & {x.doc_id for x in out.collect()}
        out = stage["tokens"](spark, table, str(tmp_path))
        assert out.count() == len(rows) and out.where("doc_id = 60 and n_tokens = 1").count() == 1
        for name, f in cp.STAGES:
            none = f(spark, table.limit(0), str(tmp_path))
            assert none.count() == 0 and (name == "tokens" or none.columns == table.columns)
