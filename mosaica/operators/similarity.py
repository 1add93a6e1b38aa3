"""Content-based similarity: bags of local descriptors over a codebook.

Histograms are sparse rows (object, cw, w).  A descriptor goes to its ``m`` nearest words by one matrix product a batch,
so assignment has no shuffle; only the sum by object and word has.  ``MediaIndex`` keeps codebook, bags and postings
as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Centroids that may be one literal array: a codebook has 16 to 4096 words.
MOST_WORDS = 4096


def book_matrix(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(words, centroids) in order of the words: ``MOST_WORDS`` rows at most."""
    rows = sorted(codebook.select("cw", F.col("centroid").cast("array<double>").alias("c")).limit(MOST_WORDS + 1).collect())
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a codebook has at most {MOST_WORDS} words")
    return np.array([r.cw for r in rows], np.int64), np.array([r.c for r in rows], np.float64)


def soft_assign(descriptors: DataFrame, codebook: DataFrame, obj: str = "object_id", vec: str = "vec", m: int = 3, sigma: float = 1.0) -> DataFrame:
    """(object, cw, w): weights ``exp(-d2 / (2 sigma^2))`` over the ``m`` nearest words, normalised per descriptor; of
    words that are equally near the smaller counts."""
    words, centres = book_matrix(codebook)
    m = min(m, len(words))
    half = (centres * centres).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rough, some = half - v @ centres.T, min(len(words), 2 * m + 2)
                near = np.sort(np.argpartition(rough, some - 1, axis=1)[:, :some], axis=1) if some < len(words) else np.broadcast_to(np.arange(some), (len(v), some))
                d2 = ((v[:, None, :] - centres[near]) ** 2).sum(2)  # exact for the few that can be nearest
                order = np.argsort(d2, axis=1, kind="stable")[:, :m]
                w = np.exp(-np.take_along_axis(d2, order, 1) / (2 * sigma * sigma + 1e-12))
                total = w.sum(1, keepdims=True)
                w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
                cw = words[np.take_along_axis(near, order, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(v)), m))), pa.array(cw.ravel()), pa.array(w.ravel())], [obj, "cw", "w"])

    rows = descriptors.where(F.col(vec).isNotNull()).select(obj, F.col(vec).cast("array<double>").alias("v"))
    schema = rows.select(obj, F.lit(0).cast("long").alias("cw"), F.lit(0.0).alias("w")).schema
    parts = rows.mapInArrow(run, schema) if len(words) else descriptors.sparkSession.createDataFrame([], schema)
    return parts.groupBy(obj, "cw").agg(F.sum("w").alias("w"))


def frequency(bows: DataFrame) -> DataFrame:
    """(cw, df): objects with weight on a word."""
    return bows.where("w > 0").groupBy("cw").agg(F.count("*").alias("df"))


def tfidf(bows: DataFrame, freq: DataFrame, n: int, obj: str = "object_id", sublinear: bool = True) -> DataFrame:
    """(object, cw, w) with ``ln(1 + w)`` or raw weights times ``ln((n + 1) / (df + 1)) + 1``, of norm 1."""
    w = (F.log1p("w") if sublinear else F.col("w")) * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)
    raw = bows.where("w > 0").join(freq, "cw").select(obj, "cw", w.alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(obj)))
    return raw.select(obj, "cw", F.when(size > 0, F.col("x") / size).otherwise(0.0).alias("w"))


def top(scored: DataFrame, k: int, obj: str) -> DataFrame:
    """Ranked at twelve places (sums depend on their order beyond), shown at six; ties go to the smaller object."""
    return scored.select(obj, F.round("score", 12).alias("exact")).orderBy(F.desc("exact"), obj).limit(k).select(obj, F.round("exact", 6).alias("score"))


def sequential(bows: DataFrame, query: DataFrame, k: int = 10, obj: str = "object_id") -> DataFrame:
    """Cosine of sublinear TF-IDF against every object, those that share no word with the query (score 0) too."""
    objects = bows.select(obj).distinct()
    n, freq = objects.count(), frequency(bows)
    q = tfidf(query.select(F.lit(0).alias("q"), "cw", "w"), freq, n, "q").select("cw", F.col("w").alias("qw"))
    dots = tfidf(bows, freq, n, obj).join(q, "cw").groupBy(obj).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return top(objects.join(dots, obj, "left").select(obj, F.coalesce("dot", F.lit(0.0)).alias("score")), k, obj)


def inverted(bows: DataFrame, query: DataFrame, k: int = 10, obj: str = "object_id") -> DataFrame:
    """Cosine of raw TF-IDF through postings by word: only objects that share a word with the query."""
    n, freq = bows.select(obj).distinct().count(), frequency(bows)
    q = tfidf(query.select(F.lit(0).alias("q"), "cw", "w"), freq, n, "q", sublinear=False).select("cw", F.col("w").alias("qw"))
    return top(tfidf(bows, freq, n, obj, sublinear=False).join(q, "cw").groupBy(obj).agg(F.sum(F.col("w") * F.col("qw")).alias("score")), k, obj)


def sample_descriptors(descriptors: DataFrame, per_object: int, obj: str = "object_id", number: str = "desc_no", seed: int = 42, most: int | None = None) -> DataFrame:
    """At most ``per_object`` descriptors of each object, by a hash of their number: any retry draws the same.

    With ``most``, objects are taken in the order of a hash until they have so many descriptors; the last ones, objects
    that share 16 bits of that hash, may exceed it.
    """
    order = Window.partitionBy(obj).orderBy(F.xxhash64(F.col(number), F.lit(seed)), number)
    drawn = descriptors.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_object).drop("_rank")
    if most is None:
        return drawn
    turn = F.shiftrightunsigned(F.xxhash64(F.col(obj), F.lit(seed)), 48)
    per = descriptors.groupBy(obj).agg(F.least(F.count("*"), F.lit(per_object)).alias("n"))
    last, total = -1, 0
    for r in per.groupBy(turn.alias("turn")).agg(F.sum("n").alias("n")).orderBy("turn").collect():  # 65,536 rows at most
        if total >= most:
            break
        last, total = r.turn, total + r.n
    return drawn.where(turn <= last)


def train_codebook(descriptors: DataFrame, k: int, vec: str = "vec", seed: int = 42, rounds: int = 20) -> DataFrame:
    """(cw, centroid) by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(descriptors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features")))
    return descriptors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cw int, centroid array<double>")


def root_normalise(vec: Column) -> Column:
    """L1 norm 1, then square roots."""
    v = vec.cast("array<double>")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(F.array(F.struct(v.alias("v"), total.alias("t"))), lambda s: F.transform(s["v"], lambda x: F.sqrt(x / F.greatest(s["t"], F.lit(1e-12)))))[0]


class MediaIndex:
    """Codebook, bags and postings of a collection below one folder, by modality (``image`` or ``audio``)."""

    def __init__(self, spark: SparkSession, root: str, modality: str = "image") -> None:
        if modality not in ("image", "audio"):
            raise ValueError("a modality is image or audio")
        self.spark, self.modality, self.root = spark, modality, f"{root.rstrip('/')}/{modality}"

    def _has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _read(self, name: str, what: str) -> DataFrame:
        if not self._has(name):
            raise FileNotFoundError(f"no {what} of {self.modality}: {self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def train(self, descriptors: DataFrame, k: int, per_object: int = 500, most: int = 200_000, seed: int = 42) -> dict:
        """Trains and writes the codebook (16 to 4,096 words); an index of an older one goes."""
        if not 16 <= k <= MOST_WORDS:
            raise ValueError(f"k is 16 to {MOST_WORDS}")
        drawn = self._write(sample_descriptors(descriptors, per_object, seed=seed, most=most), "sample")
        book = self._write(train_codebook(drawn, k, seed=seed), "codebook")
        words, centres = book_matrix(book)
        meta = {"modality": self.modality, "k": len(words), "dim": centres.shape[1], "sampled": drawn.count()}
        self._write(self.spark.createDataFrame([tuple(meta.values())], "modality string, k long, dim long, sampled long"), "codebook_meta")
        for name in ("bows", "frequency", "postings"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return meta

    def codebook(self) -> DataFrame:
        return self._read("codebook", "codebook")

    def index(self, descriptors: DataFrame) -> dict:
        """Writes the bags, document frequencies, and postings by word of TF-IDF weights (raw, as ``inverted`` uses them)."""
        bows = self._write(soft_assign(descriptors, self.codebook()).repartition("object_id"), "bows")
        freq = self._write(frequency(bows).coalesce(1), "frequency")  # MOST_WORDS rows at most
        n = bows.select("object_id").distinct().count()
        weighed = tfidf(bows, F.broadcast(freq), n, sublinear=False)
        self._write(weighed.repartitionByRange("cw", "object_id").sortWithinPartitions("cw", "object_id"), "postings")
        return {"objects": n, "words": freq.count()}

    def bows(self) -> DataFrame:
        return self._read("bows", "index")

    def status(self) -> dict:
        """What there is; what there is not is None."""
        out: dict = {"modality": self.modality, "codebook": None, "index": None}
        if self._has("codebook_meta"):
            out["codebook"] = self._read("codebook_meta", "codebook").first().asDict()
        if self._has("postings"):
            out["index"] = {"objects": self.bows().select("object_id").distinct().count(), "words": self._read("frequency", "index").count()}
        return out

    def search(self, descriptors: DataFrame, k: int = 10, method: str = "inverted") -> DataFrame:
        """(object_id, score) of the ``k`` objects nearest to one query's descriptors."""
        if not 1 <= k <= 100:
            raise ValueError("k is 1 to 100")
        bows, one = self.bows(), descriptors.withColumn("object_id", F.lit("query"))
        query = soft_assign(one, self.codebook())
        if method == "sequential":
            return sequential(bows, query, k)
        n = bows.select("object_id").distinct().count()
        q = {r.cw: r.w for r in tfidf(query, self._read("frequency", "index"), n, sublinear=False).collect()}  # a row a word
        if not q:
            return bows.select("object_id", F.lit(0.0).alias("score")).limit(0)
        of_word = F.create_map(*(F.lit(x) for item in sorted(q.items()) for x in item))
        hits = self._read("postings", "index").where(F.col("cw").isin(sorted(q))).groupBy("object_id").agg(F.sum(F.col("w") * of_word[F.col("cw")]).alias("score"))
        return top(hits, k, "object_id")
