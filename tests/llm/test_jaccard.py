import random
import re

import numpy as np
import pytest

from mosaica.llm import components as components_module
from mosaica.llm import jaccard, queries
from mosaica.llm.common import table
from mosaica.llm.components import components


def brute(rows, percent=85, width=4):
    """Components by comparing every pair that shares a shingle."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posts = {}
    for i, s in enumerate(sets):
        for g in s:
            posts.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in posts[g] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return sorted(((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert result(queries.op3_jaccard_components(spark, sf)) == brute(rows)


@pytest.mark.parametrize(("part", "short", "forests"), [(4, 6, 3), (7, 2, 0), (2048, 64, 3)])
def test_edited_copies(make_docs, monkeypatch, part, short, forests):
    """Groups where copies link to the original, to each other or to nothing."""
    monkeypatch.setattr(jaccard, "OUTSIDE", part)
    monkeypatch.setattr(jaccard, "MEMBERS", part * 3)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "FORESTS", forests)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = [rng.choice(words) for _ in range((8, 15, 21, 27, 60, 150)[group])]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 30)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert result(jaccard.join_components(make_docs(rows))) == brute(rows)


def test_edges(make_docs):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "one two"), (5, "One  two"), (4, "one two three"), (None, "a b c d e"), (None, "f g h i j"), (3, "a b C d e"), (3, "q r s t"), (2, "x " * 60000), (1, "x " * 5), (0, "é É b c d")]
    docs = make_docs(rows).withColumnRenamed("n_chars", "n").withColumnRenamed("lang", "node")
    assert result(jaccard.join_components(docs)) == brute(rows)
    assert jaccard.join_components(make_docs([])).count() == 0


def test_boundary_follows_cost():
    sizes = {s: 1000 for s in range(6, 40)}
    assert jaccard.choose_boundary(sizes, {s: 1e9 for s in sizes}, 85) == jaccard.LARGEST_LIGHT
    assert jaccard.choose_boundary(sizes, {s: 0.1 for s in sizes}, 85) < 6
    assert 6 <= jaccard.choose_boundary(sizes, {s: 100.0 for s in sizes}, 85) < jaccard.LARGEST_LIGHT


@pytest.mark.parametrize("at_once", [20, components_module.AT_ONCE])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components_module, "AT_ONCE", at_once)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2100)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(at_once > 100).lower())
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.node: r.root for r in rows}
    assert got == {i: find(i) for i in parent} and len(rows) == len(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_lose_no_link():
    """Two sketches differ in no more bits than the sets differ in shingles, whatever their sizes."""
    rng = np.random.default_rng(2)
    for n, m, common in [(0, 1, 0), (3, 4, 3), (8, 9, 8), (60, 70, 60), (63, 64, 60), (500, 590, 499), (4000, 4100, 3900), (200_000, 210_000, 190_000)]:
        every = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.int64).astype(np.uint64))[: n + m]
        one, other = every[:n], every[n - common : n - common + m]
        a, b = (np.frombuffer(jaccard.sketch(x), np.uint64)[None, :] for x in (one, other))
        words = min(a.shape[1], b.shape[1])
        differ = int(np.bitwise_count(jaccard.folded(a, words) ^ jaccard.folded(b, words)).sum())
        assert differ <= len(np.setxor1d(one, other)) and words * 64 >= 4 * min(n, m, 100_000)
        if n:
            linked = 100 * common >= 85 * (n + m - common)
            kept = jaccard.may_link(np.array([n]), [jaccard.sketch(one)], np.array([m]), [jaccard.sketch(other)], 85)[0]
            assert kept or not linked


def test_many_near_copies_that_do_not_all_link(make_docs, monkeypatch):
    """5,000 copies of one text: some link with it, some only with each other, some with nothing."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(5000):
        copy = list(base)
        for _ in range((0, 1, 2, 3, 3, 4, 5)[i % 7]):
            copy[rng.randrange(90)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(jaccard, "OUTSIDE", 512)
    monkeypatch.setattr(jaccard, "MEMBERS", 2048)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(make_docs(rows)).collect()}
    # brute force by products of 0/1 matrices
    sets = [np.unique(list(map(hash, zip(*(t.split()[k:] for k in range(4)), strict=False)))) for _, t in rows]
    vocabulary = np.unique(np.concatenate(sets))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(vocabulary, s)] = 1
    n, root = x.sum(1), np.arange(len(rows))
    linked = []
    for a in range(0, len(rows), 500):
        common = x[a : a + 500] @ x.T
        linked.append(100 * common >= 85 * (n[a : a + 500, None] + n[None, :] - common))
    linked = np.concatenate(linked)
    while True:
        low = np.array([root[linked[i]].min() for i in range(len(rows))])
        if (low == root).all():
            break
        root = low
    assert got == dict(enumerate(root.tolist()))
    assert 100 < len(set(root.tolist())) < 4900


def jobs_of(spark, run):
    jobs = spark.sparkContext._jsc.sc().dagScheduler()
    before = jobs.numTotalJobs()
    out = run()
    return jobs.numTotalJobs() - before, out


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_links_take_few_jobs(spark, monkeypatch, many_partitions):
    """A chain over many partitions is contracted at once, and so are the few stars of many links."""
    chain = spark.createDataFrame([(i + 1, i) for i in random.Random(5).sample(range(400), 400)], "a long, b long").repartition(32)
    jobs, rows = jobs_of(spark, lambda: components(chain).collect())
    assert jobs <= 8 and sorted(map(tuple, rows)) == [(i, 0) for i in range(401)]
    monkeypatch.setattr(components_module, "AT_ONCE", 60)
    often = spark.createDataFrame([(i % 7, (i + 1) % 7) for i in range(100)], "a long, b long").repartition(5)
    assert sorted(map(tuple, components(often).collect())) == [(i, 0) for i in range(7)]


def test_levels_come_in_few_jobs(spark, many_partitions):
    texts = spark.createDataFrame([(f"w{i % 50} b c d e w{i % 50} g",) for i in range(200)], "text string").repartition(3)
    jobs, level = jobs_of(spark, lambda: jaccard.frequency_levels(texts, 4))
    assert jobs <= 12 and level.max() == 7
