"""The pipeline's stages against brute force, each on its own input."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mosaica.llm import decontaminate
from mosaica.llm.common import save, table, written
from mosaica.llm.queries import BYTE_BPE
from tests.llm.test_jaccard import brute
from tests.llm.test_suffixes import covered

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    frames = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(save(stage(spark, frames[-1], SF)))
    return frames


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    assert all(f.dtypes == stages[0].dtypes for f in stages[:-1])
    assert [f.count() for f in stages] == sorted((f.count() for f in stages), reverse=True)


def test_quality(spark, stages):
    kept, labels = texts(stages[1]), table(spark, SF, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) < 0.05 * len(bad)


def test_one_of_each_group(stages):
    want = {c for _, _, c in brute(list(texts(stages[1]).items()), percent=80, width=5)}
    assert set(texts(stages[2])) == want


def test_repeats_are_cut(stages):
    before, after = texts(stages[2]), texts(stages[3])
    places = covered(list(before.items()))
    assert all(after[i] == t for i, t in before.items() if i not in places)
    assert not covered(list(after.items()))


def test_benchmark_is_gone(spark, stages):
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    holds = {i for i, t in before.items() if any(x in flat(t) for x in items)}
    assert not holds & set(after) and len(before) - len(after) <= len(holds) + 3
    assert decontaminate.contaminated(stages[4], table(spark, SF, "benchmark")).count() == 0


def test_tokens(stages):
    lib, docs = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE)), texts(stages[4])
    rows = stages[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_input(spark, make_docs, name):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""
    work = dict(corpus_pipeline.STAGES)[name]
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, None), (2, ""), (3, " \n"), (None, None), (None, "no id " + passage), (4, "repeated words of a row"), (4, "repeated words of a row"),
        (5, "before " + passage + " after"), (6, "others " + passage + " then"), (7, " ".join(f"w{i % 5003}" for i in range(150_000))), (8, "x" * 300_000), (9, "tie one two three"), (9, "tie one two four"),
    ]
    docs = make_docs(rows)
    names = "row log_weight gumbel_key noise node n h1 h2 comp root t1 _t1 _t2 cut _cut first later _first _later _doc_id _text_hash bad_id bad_hash text_hash mark key ids part c0 n_tokens".split()
    more = docs.select("*", *(F.lit("mine").alias(c) for c in names))
    want = sorted(map(str, save(work(spark, docs, SF)).collect()))
    out = save(work(spark, more, SF))
    if name != "bpe_encoding":
        assert out.columns == more.columns and all(r[c] == "mine" for r in out.collect() for c in names)
    assert sorted(map(str, out.select(*[c for c in out.columns if c not in names or name == "bpe_encoding"]).collect())) == want
    assert work(spark, more.limit(0), SF).count() == 0
    kept = {r.doc_id for r in out.collect()}
    if name == "ngram_jaccard_join":  # 6 and one without id are near copies of 5
        assert kept - {None} == {1, 2, 3, 4, 5, 7, 8, 9} and sum(r.text is None for r in out.collect()) == 2
    elif name in ("suffix_array_dedup", "benchmark_decontamination"):
        assert kept >= {1, 2, 3, 4, 5, 6, 7, 8, 9}
    count = sum(r.doc_id == 4 for r in out.collect())
    assert count == {"ngram_jaccard_join": 1}.get(name, 2)


def test_run_leaves_one_table(spark, sf):
    """At the smallest size: what the stages wrote is gone but for the result."""
    before = set(written())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    left = [p for p in written() if p not in before and p not in corpus_pipeline._LEFT]
    assert left == [out._mosaica_path]
