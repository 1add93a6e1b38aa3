"""Importance resampling by hashed n-gram models, drawn with Gumbel top-k.

Features are words, marks and pairs of neighbours, hashed into ``BUCKETS``; a pair of equal words is one
feature.  Two multinomial models are counted: of the target (labelled rows of good quality that are not toxic, a
sample bounded by ``labelled``) and of the raw text (every document).  The log importance weight of a document is the
log ratio of its likelihoods, the sum of log p_target / p_raw over its features.  A text whose largest feature
evidence for toxicity (log odds of a feature among labelled toxic texts against others) is beyond a bar has weight
zero: one toxic word is enough, however long the text.

Gumbel noise, a hash of seed, id and text, is added to the log weights and the ``k`` largest stay: a draw without
replacement in proportion to the weights that any retry repeats.  Without a ``k`` as many are drawn as have a weight
that labelled good rows have too (a bar fitted on labelled rows that the model has not counted).

Edge cases: a null text, one with no feature, and a toxic one have weight zero and are never drawn; a null id is drawn like
any other; equal rows have equal keys and rows that tie with the last drawn one are all drawn; without labels all
weights are equal and every document with a feature is drawn; an empty table gives no rows; other columns are
kept; columns that clash with ``log_weight`` and ``gumbel_key`` are replaced by ``resample`` and kept by ``drawn``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import save, text_chunks, tidied
from mosaica.llm.hashing import grams, mix, split_words

BUCKETS = 1 << 16
RESULTS = ("log_weight", "gumbel_key")


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every feature."""
    w = split_words(texts, marks=True, lower=False)
    pair = grams(w.hash, 2)
    pair = np.where(w.hash[1:] == w.hash[:-1], np.uint64(1), pair) if len(pair) else pair
    inside = w.doc[1:] == w.doc[:-1]
    doc = np.concatenate([w.doc, w.doc[1:][inside]])
    h = np.concatenate([w.hash, mix(pair[inside] + np.uint64(7))])
    return doc, h


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every feature."""
    doc, h = hashes(texts)
    return doc, (h >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray  # log p_target - log p_raw of each bucket
    bar: float  # least score of a document that counts as good
    toxic: np.ndarray | None = None  # sorted hashes, unbucketed, of features that toxic texts have more often
    odds: np.ndarray | None = None  # their log odds among toxic texts against others
    toxic_bar: float = np.inf  # greatest evidence of a document that does not count as toxic

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The largest log odds of each text's features: one toxic word counts the same in a long text."""
        out = np.zeros(len(texts))
        if self.toxic is not None and len(self.toxic):
            doc, h = hashes(texts)
            at = np.minimum(np.searchsorted(self.toxic, h), len(self.toxic) - 1)
            hit = self.toxic[at] == h
            np.maximum.at(out, doc[hit], self.odds[at[hit]])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The log ratio of each text's likelihoods, NaN without any feature."""
        doc, bucket = features(texts)
        total = np.bincount(doc, self.ratio[bucket], minlength=len(texts))
        return np.where(np.bincount(doc, minlength=len(texts)) > 0, total, np.nan)


def labelled_ids(labels: DataFrame, good: Column, limit: int) -> np.ndarray:
    """At most ``limit`` ids, by a hash: the documented bound of the fit."""
    rows = labels.where(good & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return np.sort(np.array([r.doc_id for r in rows.collect()], np.int64))


def member(ids: pa.Array, sample: np.ndarray) -> np.ndarray:
    return np.isin(pc.fill_null(ids, 0).to_numpy(), sample) & ids.is_valid().to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, smoothing: float = 256.0, keep: float = 0.99, keep_harmless: float = 0.995, margin: float = 4.0) -> Model:
    """Counts raw text over all documents and the target over the labelled sample, then sets the bar.

    Half of the labelled rows, by a hash of the id, is the target; the other half sets the bar, as rows that the
    model has counted score higher than others.  The bar keeps at least ``keep`` of the good rows; among such
    bars it parts good from bad best.  It is lowered by ``margin``, three deviations of the Gumbel noise, so that the
    noise seldom takes a good row.
    """
    good_rule = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    good, bad = labelled_ids(labels, good_rule, labelled), labelled_ids(labels, ~good_rule, labelled)
    toxic, harmless = labelled_ids(labels, F.col("toxic") == 1, labelled), labelled_ids(labels, F.col("toxic") == 0, labelled)
    half = lambda ids: (mix(ids.astype(np.uint64)) & np.uint64(1)).astype(bool)
    toxic_half, harmless_half, toxic_rest = toxic[half(toxic)], harmless[half(harmless)], toxic[~half(toxic)]
    counted_half = (mix(good.astype(np.uint64)) & np.uint64(1)).astype(bool)
    goal, good = good[counted_half], good[~counted_half]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = member(batch.column(0), goal)
            for a, texts in text_chunks(batch.column(1)):
                doc, bucket = features(texts)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[own[a : a + len(texts)][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(tidied(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted["bucket"]], target[counted["bucket"]] = counted["raw"], counted["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    ratio = np.log((target + smoothing) / (raw * target.sum() / raw.sum() + smoothing))
    model = Model(ratio, -np.inf)
    if not len(bad):
        return model
    if len(toxic_half) and len(harmless_half):
        model.toxic, model.odds = toxic_features(rows, toxic_half, harmless_half)
    sample = np.union1d(good, bad)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(member(whole.column(0), sample)))
            for a, texts in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(member(ids, good)), pa.array(member(ids, toxic_rest)), pa.array(model.score(texts)), pa.array(model.evidence(texts))], ["good", "toxic", "score", "evidence"])

    seen = rows.mapInArrow(tidied(score), "good boolean, toxic boolean, score double, evidence double").toPandas()
    model.bar = bar(seen["score"][seen["good"]].to_numpy(), seen["score"][~seen["good"]].to_numpy(), keep) - margin
    if model.toxic is not None:
        # ``bar`` takes what is large as good
        model.toxic_bar = -bar(-seen["evidence"][seen["good"]].to_numpy(), -seen["evidence"][seen["toxic"]].to_numpy(), keep_harmless)
    return model


def toxic_features(docs: DataFrame, toxic: np.ndarray, harmless: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of two toxic texts at least that are more frequent there, and their log odds; texts are counted."""
    both = np.union1d(toxic, harmless)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(member(whole.column(0), both)))
            for a, texts in text_chunks(batch.column(1)):
                doc, h = hashes(texts)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)]
                bad = member(batch.column(0).slice(a, len(texts)), toxic)[doc[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((~bad).astype(np.int64))], ["h", "toxic", "harmless"])

    odds = F.log((F.col("toxic") + 1) / (F.col("harmless") * (len(toxic) / len(harmless)) + 1))
    found = docs.mapInArrow(tidied(run), "h long, toxic long, harmless long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"))
    found = found.where(F.col("toxic") >= 2).select("h", odds.alias("odds")).where("odds > 0").toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["odds"].to_numpy(np.float64)[order]


def bar(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    good, bad = np.sort(good[~np.isnan(good)]), np.sort(bad[~np.isnan(bad)])
    if not len(good) or not len(bad):
        return -np.inf
    tries = np.unique(np.concatenate([good[: int((1 - keep) * len(good)) + 1], bad[bad <= good[int((1 - keep) * len(good))]]]))
    lost, caught = np.searchsorted(good, tries) / len(good), np.searchsorted(bad, tries) / len(bad)
    return float(tries[np.argmax(caught - lost)])


def gumbel(log_weight: Column, *key: Column | str) -> Column:
    """``log_weight`` with Gumbel noise that is a hash of ``key``."""
    uniform = (F.pmod(F.xxhash64(F.lit("gumbel"), *key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return log_weight - F.log(-F.log(uniform))


def weigh(docs: DataFrame, model: Model, columns: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(row, struct of ``columns`` but for text; text, if among them; log_weight; gumbel_key); weight zero is null."""
    columns = docs.columns if columns is None else columns
    with_text = "text" in columns
    rest = F.struct(*([F.col(c) for c in columns if c != "text"] or [F.lit(None).cast("int").alias("none")])).alias("row")
    noise = gumbel(F.lit(0.0), F.lit(seed), "doc_id", "text").alias("noise")
    rows = docs.select(rest, noise, F.col("text").cast("string").alias("text"))
    schema = rows.select("row", "noise", *["text"] * with_text, F.lit(None).cast("double").alias("log_weight")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_chunks(batch.column(2)):
                scores = np.where(model.evidence(texts) > model.toxic_bar, np.nan, model.score(texts))
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: 2 + with_text], pa.array(scores, mask=np.isnan(scores))], schema.names)

    made = rows.mapInArrow(tidied(run), schema)
    return made.select("row", *["text"] * with_text, "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key"))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1024, enough: int = 10_000) -> float | None:
    """The k-th largest value, by histograms that close in on it; at most ``enough`` values are fetched."""
    key = F.col(column)
    rows = keys.where(key.isNotNull()).select(key)
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    above = 0  # values beyond ``high``
    while n > enough and low < high:
        place = F.least(F.floor((key - low) / (high - low) * bins), F.lit(bins - 1))
        found = rows.where(key.between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n
    if low == high:
        return low
    values = sorted((r[0] for r in rows.where(key.between(low, high)).collect()), reverse=True)
    return values[k - above - 1]


def draw(docs: DataFrame, labels: DataFrame, labelled: int, columns: list[str], k: int | None, seed: int) -> DataFrame:
    """The drawn rows of ``weigh``."""
    model = fit(docs, labels, labelled)
    weighed = save(weigh(docs, model, columns, seed))
    if k is None:
        k = weighed.where(F.col("log_weight") >= F.lit(model.bar)).count()
    least = kth_largest(weighed, "gumbel_key", k)
    return weighed.where(F.col("gumbel_key") >= F.lit(least)) if least is not None else weighed.limit(0)


def resample(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, columns: list[str] | None = None, k: int | None = None, seed: int = 0) -> DataFrame:
    """The drawn rows of ``docs`` (``columns`` of them), with ``log_weight`` and ``gumbel_key``."""
    columns = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    out = draw(docs, labels, labelled, columns, k, seed)
    return out.select(*(F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in columns), *RESULTS)


def drawn(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, k: int | None = None, seed: int = 0) -> DataFrame:
    """The drawn rows of ``docs``, as they are."""
    out = draw(docs, labels, labelled, docs.columns, k, seed)
    return out.select(*(F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
