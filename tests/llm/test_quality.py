import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.llm import hashing, quality, queries
from mosaica.llm.common import table

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_words():
    texts = ["The cat  sat", None, "", "on\tthe\x0bCAT", "thecat é É", "x" * 9000]
    w = hashing.split_words(texts)
    words = [x for t in texts for x in (t or "").lower().split()]
    words[-2] = "É"  # only A-Z are lowered
    assert w.count.tolist() == [3, 0, 0, 3, 3, 1]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (w.hash[i] == w.hash[j]) == (a == b)
    assert len(np.unique(hashing.split_words([" ".join(map(str, range(50000)))]).hash)) == 50000
    h = w.hash
    assert (hashing.grams(h, 3) == hashing.grams(h.copy(), 3)).all() and len(hashing.window_hash(h, 11)) == 0


def test_draw_keeps_good_rejects_bad(spark):
    rows = {r.doc_id for r in queries.op5_importance_resampling(spark, SF).collect()}
    labels = table(spark, SF, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in rows for i in good) > 0.97 * len(good)
    assert sum(i in rows for i in bad) < 0.05 * len(bad)


def own_features(text):
    """Words, marks and pairs of neighbours, as text: a plain form of what ``features`` hashes."""
    parts = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+|[^A-Za-z0-9_\x80-\U0010ffff \t\n\x0b\x0c\r]+", text or "")
    return [*parts, *(("equal",) if a == b else (a, b) for a, b in zip(parts, parts[1:], strict=False))]


def test_result_against_brute_force(spark):
    """At sf0.01: weights, bar and draw, from features that are no hashes."""
    docs, labels = table(spark, SF, "documents").collect(), table(spark, SF, "labels").collect()
    half = {r.doc_id: bool(int(hashing.mix(np.array([r.doc_id], np.uint64))[0]) & 1) for r in labels}
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    goal = {i for i in good if half[i]}
    assert len(goal) > 50
    raw, target = Counter(), Counter()
    for r in docs:
        f = own_features(r.text)
        raw.update(f)
        if r.doc_id in goal:
            target.update(f)
    share = sum(target.values()) / sum(raw.values())
    weight = {r.doc_id: sum(math.log((target[x] + 256) / (raw[x] * share + 256)) for x in f) for r in docs if (f := own_features(r.text))}
    got = {r.doc_id: r for r in queries.op5_importance_resampling(spark, SF).collect()}
    near = [abs(got[i].log_weight - weight[i]) for i in got]
    assert np.quantile(near, 0.9) < 3 and np.median(near) < 0.6  # buckets are shared by some features
    bad = {r.doc_id for r in labels} - good
    bar = quality.bar(np.array([weight[i] for i in good if not half[i] and i in weight]), np.array([weight[i] for i in bad if i in weight]), 0.99) - 4
    kept = {i for i, w in weight.items() if w >= bar}
    toxic = {r.doc_id for r in labels if r.toxic}
    assert len((kept ^ set(got)) - toxic) < 0.05 * len(weight)


def test_gumbel_draws_by_weight(spark):
    """Over many seeds a row is drawn first as often as its share of the weights says, and second as often among the rest."""
    weights, seeds = [1.0, 2.0, 4.0, 8.0], 4000
    rows = spark.createDataFrame([(i, math.log(w)) for i, w in enumerate(weights)], "doc_id long, log_weight double").crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    order = rows.withColumn("key", quality.gumbel(F.col("log_weight"), "seed", "doc_id")).groupBy("seed").agg(F.reverse(F.array_sort(F.collect_list(F.struct("key", "doc_id")))).alias("o")).select(F.col("o.doc_id")[0].alias("a"), F.col("o.doc_id")[1].alias("b")).collect()
    first, both = Counter(r.a for r in order), Counter((r.a, r.b) for r in order)
    for i, w in enumerate(weights):
        assert abs(first[i] / seeds - w / 15) < 0.03
        for j, v in enumerate(weights):
            if i != j:
                assert abs(both[i, j] / seeds - w / 15 * v / (15 - w)) < 0.03


def test_seed_and_k(spark, make_docs):
    """The noise decides among near weights: other seeds draw other rows, ``k`` of them."""
    docs = make_docs([(i, f"some words {i % 7}") for i in range(60)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    draws = [{r.doc_id for r in quality.resample(docs, none, k=20, seed=s).collect()} for s in range(3)]
    assert all(len(d) == 20 for d in draws) and draws[0] != draws[1] != draws[2]


@pytest.mark.parametrize("k", [1, 2, 37, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    values = np.round(np.random.default_rng(0).normal(size=1000), 2)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert quality.kth_largest(frame, "x", k, bins=16, enough=20) == np.sort(values)[::-1][min(k, 1000) - 1]
    assert quality.kth_largest(frame.limit(0), "x", k) is None


def test_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "fine words"), (None, "fine words"), (4, "fine words"), (4, "fine words"), (5, "w " * 100000)]).withColumnRenamed("source", "log_weight")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.resample(docs, none).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "4", "4", "5", "None"]
    assert quality.resample(make_docs([]), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (3, None, None), (4, 0, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, odd).count() == 5
    as_they_are = quality.drawn(docs.withColumn("log_weight", F.lit("mine")).withColumn("row", F.lit("too")), none)
    assert as_they_are.columns == [*docs.columns, "row"] and {(r.log_weight, r.row) for r in as_they_are.collect()} == {("mine", "too")}


def test_toxic_documents_go(spark):
    """At sf0.1: half of the toxic labels are learned from, and sf0.01 has about twenty of them."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id for r in queries.op5_importance_resampling(spark, sf).collect()}
    toxic = [r.doc_id for r in table(spark, sf, "labels").collect() if r.quality == 1 and r.toxic == 1]
    held_out = [i for i in toxic if not int(hashing.mix(np.array([i], np.uint64))[0]) & 1]
    assert len(held_out) > 5 and sum(i in rows for i in held_out) < 0.1 * len(held_out)
