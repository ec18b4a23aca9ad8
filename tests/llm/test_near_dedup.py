import pickle
import random
from collections import Counter

import numpy as np

from geoladder.llm import near_dedup as nd

W = " \t\n\r\x0b\x0c"


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def sim(a, b):
    if not a and not b:
        return 1.0
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows, least=0.8):
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sim(bags[i], bags[j]) >= least:
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(sorted(g, key=lambda x: (x is None, x or 0)) for g in groups.values())


def made(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    out = [None, "", "   ", "one two", "one  two", "one two three", "a b c d e", "a b c d e"]
    for _ in range(25):
        base = prose(r.randint(30, 200))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            x = list(base)
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = r.choice(words)
            out.append((" " if r.random() < 0.5 else "\n").join(x))
    line = prose(12)
    out += [" ".join(line * 30), " ".join(line * 31), " ".join(line * 60)]
    chain = prose(120)
    for i in range(12):  # neighbours are alike, the ends are not
        chain = chain[4:] + prose(4)
        out.append(" ".join(chain))
    return [(i * 3 if i != 20 else None, t) for i, t in enumerate(out)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        rows += [rows[12], (rows[12][0], "another text under the same id here")]
        df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id bigint, text string, comp int")
        got = {}
        for x in nd.near_duplicates(df, spark).collect():
            got.setdefault(x.comp, []).append(x.doc_id)
        assert sorted(sorted(g, key=lambda x: (x is None, x or 0)) for g in got.values()) == brute(rows)


def test_signature_is_unbiased():
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300), r.integers(1, 9, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = nd.bag_minhash(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, 300, 600]), 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    heavy = nd.bag_minhash(np.concatenate([keys[:3]] * 2), np.array([1000, 5, 1, 500, 5, 3]), np.array([0, 3, 6]), 4096)
    want = 506 / 1008
    assert abs((heavy[0] == heavy[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_components_and_keep_one(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = dict(nd.components(links, spark).collect())
    assert all(got[i] == 0 for i in range(n + 1)) and got[101] == got[100] == 100
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "z"), (3, "q", "z"), (None, "lone", "z")], "doc_id bigint, text string, comp string")
    assert sorted((x.doc_id or 0, x.comp) for x in nd.keep_one(df, spark).collect()) == [(0, "z"), (1, "x"), (3, "z")]
    assert nd.keep_one(df.limit(0), spark).count() == 0


def test_texts_made_by_halves_are_two_nodes(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, word), (2, other), (3, word), (4, "v " * 100_000), (5, "v " * 100_000)], "doc_id bigint, text string")
    assert {x.doc_id: x.class_id for x in nd.near_duplicates(df, spark).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_crowded_links_between_components(spark, monkeypatch):
    """Many variants of one text, about as far from each other as links may be: the classes are those of all pairs, and
    the join that every pair goes through is short enough for the JVM to compile (8,000 bytes a method)."""
    r = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(120):
        x = list(base)
        for _ in range(r.randint(1, 5)):
            at = r.randrange(len(x))
            x[at : at + r.randint(0, 2)] = [r.choice(words) for _ in range(r.randint(0, 3))]
        rows.append((i, " ".join(x)))
    made, lengths = nd.verified, []

    def seen(pairs, *rest):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = pairs.select("a", "b")._jdf.queryExecution().executedPlan()
            stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
            lengths.extend(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length()))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        return made(pairs, *rest)

    monkeypatch.setattr(nd, "verified", seen)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = docs.selectExpr("doc_id as node", "doc_id as comp", "text")
    links = {tuple(x) for x in nd.across(nodes.select("node", "text"), nodes.select("node", "comp"), spark, 0.8, 5).collect()}
    bags = [bag(t) for _, t in rows]
    assert links == {(i, j) for j in range(len(rows)) for i in range(j) if sim(bags[i], bags[j]) >= 0.8}
    assert 100 < len(links) < 6000 and lengths and 0 < max(lengths) < 8000


def test_rarity_table_passes_the_driver_by(spark, monkeypatch):
    """The table of 8 MB that all tasks read lies in the shared folder, and only as long as it is read."""
    rows = [(i, " ".join("w%d" % (j if j != i else 100 + i) for j in range(60))) for i in range(12)]
    nodes = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id as node", "doc_id as comp", "text")
    sizes = []
    collect, broadcast = type(nodes).collect, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(nodes), "collect", lambda self: [sizes.append(len(pickle.dumps(got := collect(self)))), got][1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: [sizes.append(len(pickle.dumps(value))), broadcast(self, value)][1])
    links = nd.across(nodes.select("node", "text"), nodes.select("node", "comp"), spark, 0.6, 5)
    assert sum(sizes) < 20_000
    bags = [bag(t) for _, t in rows]
    assert {tuple(x) for x in collect(links)} == {(i, j) for j in range(12) for i in range(j) if sim(bags[i], bags[j]) >= 0.6}
    fs, path = nd._shared.open_fs(nd._shared.shared_root(spark) + "/geoladder")
    assert not [x.path for x in fs.get_file_info(nd._shared.pafs.FileSelector(path)) if "near-rarity" in x.path]


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Links that are few are labelled without a round, with the labels that the rounds give."""
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(-i, -i - 1) for i in range(60)] + [(1000, -900 - i) for i in range(30)] + [(7, 7)]
    pairs = [(a * 10**15, b * 10**15) for a, b in pairs]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    names, written = [], nd._shared.written
    monkeypatch.setattr(nd._shared, "written", lambda df, spark, what: [names.append(what), written(df, spark, what)][1])
    few = sorted(tuple(x) for x in nd.components(links, spark).collect())
    assert len(names) == 1
    assert few == sorted(tuple(x) for x in nd.components(links, spark, few=0).collect()) and len(names) > 4
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert few == sorted(least.items())
    assert nd.components(links.limit(0), spark).count() == 0


def test_tasks_of_a_run(spark):
    """What a run costs where many partitions are held: their number times the shuffles that it makes."""
    docs = spark.createDataFrame(made(3), "doc_id bigint, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("near-tasks", "near_duplicates")
        assert nd.near_duplicates(docs, spark).count() == len(made(3))
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks < 40 * 22
