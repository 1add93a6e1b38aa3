"""Language identification by string kernels.

A text is the set of its letter n-grams of 1 to 3 characters (a blended spectrum, presence only); a gram is
its whole code points, hashed into one of ``DIMENSIONS`` bins.  The kernel of two texts is the size of their common set
over the geometric mean of both sizes.  Nyström landmarks ``Z`` give features ``K(x, Z) K(Z, Z)^(-1/2)``;
one-versus-rest kernel ridge regression on them gives a margin for each language.  A batch is scored by two matrix
products: ``X Z'`` over the norms, then landmarks by languages (``K(Z, Z)^(-1/2)`` is folded into that matrix).

Training texts are a sample of about ``per_language`` different texts of each language, by a hash of the text
(documented bound of the fit); scoring reads every whole text.

Edge cases: a null text, and one with no letter, is ``und`` with score 0, as is every row when nothing can be
learned; a null id counts as not held out but is not learned from; null languages are never learned.
Of equal margins the language that sorts first wins.  Repeated rows get equal predictions and are learned from once;
columns that clash with ``lang_pred`` and ``score`` are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import CACHES, text_chunks, tidied
from mosaica.llm.hashing import mix

DIMENSIONS = 8192
ORDERS = (1, 2, 3)
#: Rows of a matrix product.
BLOCK = 512
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []
CACHES["langid"] = _LETTERS.clear


def letters() -> np.ndarray:
    """Each code point, 0 if it is no letter."""
    if not _LETTERS:
        points = np.arange(0x110000)
        known = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in points), bool, len(points))
        _LETTERS.append(np.where(known, points, 0).astype(np.uint32))
    return _LETTERS[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0/1 bins as float32, and whether a text has a letter."""
    low = [(t or "").lower() for t in texts]
    size = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    codes = letters()[np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64) if low else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(low)), size)
    x = np.zeros((len(low), DIMENSIONS), np.float32)
    gram, some = codes, codes > 0
    has = np.zeros(len(low), bool)
    has[row[some]] = True
    for n in ORDERS:
        if n > 1:  # the letter n-1 places on joins (21 bits hold any code point); what begins in one text ends in it
            gram = gram[:-1] | (codes[n - 1 :] << np.uint64(21 * (n - 1)))
            some = some[:-1] | (codes[n - 1 :] > 0)
        inside = some & (row[: len(gram)] == row[n - 1 :])
        bins = (mix(gram[inside] + np.uint64(n << 60)) >> np.uint64(51)).astype(np.int64)  # no letter needs its 19th bit or more
        x[row[: len(gram)][inside], bins] = 1
    return x, has


def packed(x: np.ndarray) -> np.ndarray:
    return np.packbits(x.astype(bool), axis=1)


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    bits: np.ndarray  # landmarks, a bit a bin
    coefficients: np.ndarray  # landmarks by languages

    @property
    def landmarks(self) -> np.ndarray:
        if "z" not in self.__dict__:
            self.z = unpacked(self.bits)
        return self.z

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "z"}


NOTHING = Model([], np.zeros((0, DIMENSIONS // 8), np.uint8), np.zeros((0, 0), np.float32))


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    nx, nz = np.sqrt(x.sum(1)), np.sqrt(z.sum(1))
    return (x @ z.T) / np.maximum(nx, 1)[:, None] / np.maximum(nz, 1)[None, :]


def fit_matrix(x: np.ndarray, lang: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """Nyström features and ridge regression on rows in a fixed order; landmarks go round the languages."""
    names = sorted(set(lang))
    own = {n: [i for i, v in enumerate(lang) if v == n] for n in names}
    turn = sorted((k, n, i) for n in names for k, i in enumerate(own[n]))
    z = x[[i for _, _, i in turn[:landmarks]]]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(x, z).astype(np.float64) @ root
    target = np.where(np.array(lang)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1 / len(own[v]) for v in lang])[:, None]  # languages weigh alike
    solved = np.linalg.solve(features.T @ (share * features) + ridge * np.eye(features.shape[1]), features.T @ (share * target))
    return Model(names, packed(z), (root @ solved).astype(np.float32))


def fit(docs: DataFrame, learn: Column, per_language: int = 500, landmarks: int = 256) -> Model:
    """A model of the rows that ``learn`` admits; about ``per_language`` different texts of each language are read.

    Nothing but text and language is learned from: the draw is a hash of the text, and copies of a text are one.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    share = {r.lang: min(1.0, per_language / max(1, r.n)) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not share:
        return NOTHING
    rate = F.create_map(*(F.lit(v) for item in share.items() for v in item))[F.col("lang")]
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in blocks(batch.column(0)):
                x, has = presence(texts)
                keep = pa.array(has)
                part = batch.slice(a, len(texts)).filter(keep)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in packed(x)[has]], pa.binary()), part.column(1), part.column(2)], ["bits", "lang", "h"])

    found = drawn.mapInArrow(tidied(run, "langid"), "bits binary, lang string, h long").collect()
    if not found:
        return NOTHING
    found.sort(key=lambda r: (r.h % (1 << 30), r.h, r.lang, r.bits))
    x = unpacked(np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1))
    return fit_matrix(x, [r.lang for r in found], landmarks)


def blocks(column: pa.Array) -> Iterator[tuple[int, list]]:
    for a, texts in text_chunks(column):
        for k in range(0, len(texts), BLOCK):
            yield a + k, texts[k : k + BLOCK]


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    x, has = presence(texts)
    margin = kernel(x, model.landmarks) @ model.coefficients
    best = margin.argmax(1)
    odds = np.exp(4 * (margin - margin.max(1, keepdims=True)).astype(np.float64))
    return [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, 1 / odds.sum(1), 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``text`` replaced by ``lang_pred`` and ``score``; only the text is looked at."""
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            sure = np.zeros(batch.num_rows)
            for a, texts in blocks(batch.column(0)):
                found, sure[a : a + len(texts)] = score(model, texts)
                names += found
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(sure)], [*kept, "lang_pred", "score"])

    return docs.select("text", *kept).mapInArrow(tidied(run, "langid"), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
