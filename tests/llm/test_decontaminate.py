import time

import pytest
from pyspark.sql import functions as F

from mosaica.llm import decontaminate as dc
from mosaica.llm import queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


def test_sql(spark):
    frame = queries.op1_template_decontamination(spark, SF)
    plan = frame._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert_same(frame, queries.ORACLE["op1_template_decontamination"], SF)


QUESTION = "On Monday the baker Anna sold 12 loaves for 30 euros and then Anna sold 12 more to Mr Olsen before noon. How much did she earn?"
OTHER = QUESTION.replace("Anna", "Peter").replace("12", "7").replace("30", "8")
MIXED = QUESTION.replace("Anna", "Peter", 1).replace("12", "7", 1).replace("baker", "old baker").replace("noon", "dusk")


@pytest.mark.parametrize("limit", [dc.BROADCAST_WINDOWS, -1])
def test_slots(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame([(1, QUESTION), (2, "tiny text"), (3, None), (4, ""), (5, "what is five plus six"), (1, QUESTION)], "item_id long, text string")
    filler = "the river ran on under a grey sky while nobody spoke a word "
    docs = make_docs([
        (1, filler + QUESTION.upper().lower()), (2, filler + QUESTION + " " + filler), (3, filler + OTHER), (4, MIXED), (5, filler * 2000), (6, None), (7, ""),
        (8, "so what is  five, plus six?"), (None, QUESTION), (9, "tiny text"), (2, filler + QUESTION + " " + filler), (10, "x" * 100000), (11, (filler + QUESTION) * 40),
    ])
    got = {(r.doc_id, r.item_id): r.kind for r in dc.contaminated(docs.withColumnRenamed("lang", "item_id"), bench).collect()}
    assert got.pop((8, 5)) == "exact"
    assert {k: v for k, v in got.items() if k[0] != 4} == {(1, 1): "exact", (2, 1): "exact", (3, 1): "reparameterised", (None, 1): "exact", (11, 1): "exact"}
    assert (4, 1) not in got  # one Anna is Peter, the other is not
    kept = sorted(str(r.doc_id) for r in dc.decontaminate(docs, bench).collect())
    assert kept == sorted(["4", "5", "6", "7", "9", "10"])
    assert dc.contaminated(docs, bench.limit(0)).count() == dc.contaminated(docs.limit(0), bench).count() == 0


def test_templates(spark):
    row = spark.range(1).select(F.lit("We met Ana Lu at 5pm, then drove 30 km. Bob paid $4.50!").alias("t")).select(dc.template(dc.tokens(dc.marked(F.col("t")))).alias("t")).first()
    assert row.t == ["we", "met", "\x02", "\x02", "at", "\x01", "pm", "then", "drove", "\x01", "\x03", "bob", "paid", "\x01", "\x01"]


@pytest.mark.parametrize("limit", [dc.BROADCAST_WINDOWS, -1])
def test_copies_in_other_case_and_wrapping(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    filler = "the river ran on under a grey sky while nobody spoke a word "
    docs = make_docs([(1, filler + QUESTION.upper().lower()), (2, QUESTION.upper()), (3, QUESTION.replace(" ", "\n")), (4, QUESTION.replace(" ", "   ")), (5, filler)])
    got = {r.doc_id: (r.kind, r.coverage) for r in dc.contaminated(docs, bench).collect()}
    assert got == {i: ("exact", 1.0) for i in (1, 2, 3, 4)}
    assert [r.doc_id for r in dc.decontaminate(docs, bench).collect()] == [5]


def test_values_of_other_shape(spark, make_docs):
    sums = "Compute 12 + 7 * 3 - 4 / 2"
    story = "A shop sold 900 red apples for 3.5 euros each while Anna packed them and then Mr Olsen drove 20 boxes to town"
    items = spark.createDataFrame([(1, sums), (2, story)], "item_id long, text string")
    other = story.replace("900", "1,200").replace("3.5", "4").replace("Anna", "Mary Ann").replace("Mr Olsen", "Peter")
    docs = make_docs([(1, "so: " + sums + " = ?"), (2, sums.replace("12", "13")), (3, other), (4, story.upper()), (5, "numbers 12 7 3"), (6, other.replace("Peter drove", "Peter slowly pushed"))])
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in dc.contaminated(docs, items).collect()}
    assert got.pop((6, 2))[0] == "reparameterised"
    assert got == {(1, 1): ("exact", 1.0), (3, 2): ("reparameterised", 1.0), (4, 2): ("exact", 1.0)}


def test_folded_tokens(spark):
    row = spark.range(1).select(F.lit("Then Mary Ann Lee paid 1,234.50 and 7, 8 or 9 , 3 km").alias("t")).select(dc.tokens(dc.view(dc.marked(F.col("t")), "folded")).alias("t")).first()
    assert [x.strip("\x01\x02\x03") for x in row.t] == ["then", "mary\x02ann\x02lee", "paid", "1\x01\x01234\x01\x0150", "and", "7", "8", "or", "9", "3", "km"]


def test_clashing_columns(spark, make_docs):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    docs = make_docs([(1, QUESTION), (None, QUESTION), (2, "clean words"), (None, None), (2, "clean words")])
    more = docs.select("*", *(F.lit("mine").alias(c) for c in ("_doc_id", "_text_hash", "bad_id", "bad_hash", "text_hash", "row", "mark", "key", "pos", "item_id", "family")))
    out = dc.decontaminate(more, bench)
    assert out.columns == more.columns
    assert sorted((str(r.doc_id), r.text, r.row, r._doc_id) for r in out.collect()) == [("2", "clean words", "mine", "mine")] * 2 + [("None", None, "mine", "mine")]


def test_one_long_text_is_many_short_ones(spark, make_docs):
    """The same 120,000 words as one text and as 48 texts: about the same time, and the item is found in both."""
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    words = [f"w{i % 7919}" for i in range(120_000)]
    split = [(k, " ".join(words[k * 2500 : (k + 1) * 2500])) for k in range(48)]
    split[20] = (20, split[20][1] + " " + OTHER)
    whole = [(0, " ".join(t for _, t in split))]
    took = []
    for rows in (whole, split, whole):  # the first run compiles
        docs = make_docs(rows).coalesce(1)
        began = time.perf_counter()
        got = {(r.doc_id, r.kind) for r in dc.contaminated(docs, bench).collect()}
        took.append(time.perf_counter() - began)
        assert got == {(rows[0][0] if len(rows) == 1 else 20, "reparameterised")}
    assert took[2] < 2 * took[1] + 2
