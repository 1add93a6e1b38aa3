import zlib

import numpy as np

from mosaica.llm import langid
from mosaica.llm.common import table
from mosaica.llm.queries import op8_language_kernel

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, SF, "documents").collect()}
    rows = op8_language_kernel(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_kernel_is_the_common_share():
    texts = ["ab c", "abc", "the cat", "Ünï"]
    x, has = langid.presence(texts)
    grams = [{" ".join(t.lower().split("\n"))[i : i + n] for t in [t + " "] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    grams = [{g for g in s if any(c.isalpha() for c in g)} for s in grams]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    assert has.all() and np.allclose(langid.kernel(x, x), want, atol=0.02)


def test_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "12 %% \n"), (None, "the"), (5, "the"), (5, "the" * 5000)])
    empty = langid.fit(docs, ~langid.held_out())
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, empty).collect()} == {("und", 0.0)}
    model = langid.fit_matrix(langid.presence(["the and", "der und", "the was", "das ist"])[0], ["en", "de", "en", "de"])
    out = langid.predict(docs.withColumnRenamed("source", "score"), model).collect()
    assert sorted(str(r.doc_id) + r.lang_pred for r in out) == ["1und", "2und", "3und", "5en", "5en", "Noneen"]
    assert langid.predict(make_docs([]), model).count() == 0


def test_letters_are_told_apart():
    """Each letter has a bin of its own, but for chance: none is its code point modulo a small number."""
    bins = [int(np.flatnonzero(langid.presence([c])[0][0])[0]) for c in "aàbájéñröüçœøåæßабвгдежз日本語中文字漢"]
    assert len(set(bins)) >= len(bins) - 1


def plain_grams(text):
    """The blended spectrum as sets of strings: letters as they are, all else a blank, at least one letter."""
    flat = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return {flat[i : i + n] for n in langid.ORDERS for i in range(len(flat) - n + 1)} - {" " * n for n in langid.ORDERS}


def test_predictions_against_plain_kernel(spark):
    """Kernel ridge regression on sets of strings, without hashing or matrix products, predicts the same."""
    rows = [r for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text and r.lang]
    learn, rest = rows[:80], rows[80:160]
    x = langid.presence([r.text for r in learn])[0]
    model = langid.fit_matrix(x, [r.lang for r in learn], landmarks=24)
    names = sorted({r.lang for r in learn})
    own = {n: [i for i, r in enumerate(learn) if r.lang == n] for n in names}
    order = [i for _, _, i in sorted((k, n, i) for n in names for k, i in enumerate(own[n]))][:24]
    sets = [plain_grams(r.text) for r in learn]
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    zz = np.array([[k(sets[a], sets[b]) for b in order] for a in order])
    xz = np.array([[k(s, sets[b]) for b in order] for s in sets])
    target = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in learn])
    share = np.array([1 / len(own[r.lang]) for r in learn])[:, None]
    # the same regression in the landmarks' own basis: min |xz a - y|^2 + ridge a' zz a
    a = np.linalg.solve(xz.T @ (share * xz) + 1e-3 * zz, xz.T @ (share * target))
    want = [names[int(np.argmax(np.array([k(plain_grams(r.text), sets[b]) for b in order]) @ a))] for r in rest]
    got = langid.score(model, [r.text for r in rest])[0]
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= len(rest) - 1
