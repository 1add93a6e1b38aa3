import random

import pytest
from pyspark.sql import functions as F

from mosaica.llm import suffixes
from mosaica.llm.suffixes import MIN_WORDS


def covered(rows):
    """Word places in windows of MIN_WORDS words that another text holds too (distinct texts)."""
    texts = {}
    for i, t in rows:
        if t:
            texts[t] = min(texts.get(t, i), i)
    where = {}
    for t, i in texts.items():
        w = t.lower().split()
        for k in range(len(w) - MIN_WORDS + 1):
            where.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add(i)
    out = {}
    for t, i in texts.items():
        w = t.lower().split()
        for k in range(len(w) - MIN_WORDS + 1):
            if len(where[tuple(w[k : k + MIN_WORDS])]) > 1:
                out.setdefault(i, set()).update(range(k, k + MIN_WORDS))
    return out


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (30, 49, 50, 51, 60, 75, 120, 300)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += text(rng.randrange(0, 90))
            if rng.random() < 0.6:
                parts += rng.choice(passages)
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("at_once", [150, suffixes.ROWS])
def test_every_repeat_is_found(make_docs, monkeypatch, at_once):
    monkeypatch.setattr(suffixes, "ROWS", at_once)
    rows = corpus(1)
    got = {}
    for r in suffixes.repeated_passages(make_docs(rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.other_doc_id != r.doc_id
    assert got == covered(rows)


def test_cut_leaves_the_first_place(make_docs):
    """What goes is inside windows that an earlier text holds; a few words at their ends may stay.

    They stay where no neighbour in the suffix order shows the earlier match in full.
    """
    rows = corpus(2)
    out = {r.doc_id: r.text.split() for r in suffixes.cut(make_docs(rows)).collect()}
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - MIN_WORDS + 1):
            first.setdefault(tuple(w[k : k + MIN_WORDS]), i)
    over = total = 0
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - MIN_WORDS + 1) if first[tuple(w[k : k + MIN_WORDS])] < i for p in range(k, k + MIN_WORDS)}
        stays, left = [x for p, x in enumerate(w) if p not in gone], iter(out.get(i, []))
        assert all(x in left for x in stays)  # in this order
        over, total = over + len(out.get(i, [])) - len(stays), total + len(gone)
    assert over < 0.01 * total


def test_edges(make_docs):
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "x " + long), (5, "short text"), (6, "short text"), (7, "la " * 50000), (8, "b " + "la " * 3000), (9, long.upper() + " end")]
    docs = make_docs(rows).withColumnRenamed("source", "node")
    got = {(r.doc_id, r.kept) for r in suffixes.repeated_passages(docs).collect()}
    assert got == {(3, True), (4, False), (None, False), (7, True), (8, False), (9, False)}
    kept = {r.doc_id: r.text for r in suffixes.cut(docs).collect()}
    assert sorted(map(str, kept)) == sorted(["1", "2", "3", "5", "6", "7", "8", "9", "None"])
    assert kept[3] == long and kept[None].strip() == "x" and kept[9].strip() == "end" and kept[5] == kept[6] == "short text"
    assert suffixes.repeated_passages(make_docs([])).count() == suffixes.cut(make_docs([])).count() == 0


def test_clashing_columns(make_docs):
    rows = corpus(3, docs=30)
    docs = make_docs(rows)
    more = docs.select("*", *(F.lit("mine").alias(c) for c in ("t1", "t2", "_t1", "_t2", "cut", "first", "later", "node", "c0", "copies")))
    want = {r.doc_id: r.text for r in suffixes.cut(docs).collect()}
    out = suffixes.cut(more)
    assert out.columns == more.columns
    assert {r.doc_id: r.text for r in out.collect()} == want and {r.node for r in out.collect()} == {"mine"}
