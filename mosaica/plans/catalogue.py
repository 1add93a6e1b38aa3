"""Queries by name, and the DuckDB SQL that gives the same rows.

Query text and points are written once and used on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.functions.analysis import STOPWORDS, stem, terms, words
from mosaica.operators import relational as rel
from mosaica.operators import similarity, spatial, text
from mosaica.plans.dialect import ColumnDef
from mosaica.plans.engine import Engine
from mosaica.sources.csv import clean, read_csv, read_json_docs
from mosaica.sources.storage import scratch
from mosaica.streaming.ingest import ingest

TEXT_QUERY = "the thorer of ention and hetion"
MATCH_QUERY = "the with thand was"
POINT = (0.05, -0.02)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- scans, predicates, pages


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_project(spark, d):
    return rel.project(read(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def list_page(spark, d):
    return rel.page(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 50, 100)


def selected(spark, d, table, columns, where):
    df = read(spark, d, table)
    return df.where(where(df)).select(*columns)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def point_lookup_int(spark, d):
    return selected(spark, d, "orders", ["o_orderkey", "o_custkey"], lambda df: rel.equals(df, "o_orderkey", 77))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def point_lookup_str(spark, d):
    return selected(spark, d, "customer", ["c_custkey", "c_name"], lambda df: rel.equals(df, "c_mktsegment", "BUILDING"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 27 AND 45")
def range_int(spark, d):
    return selected(spark, d, "orders", ["o_orderkey", "o_totalprice"], lambda df: rel.between(df, "o_custkey", 26.5, 45))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100.5 AND 900.25")
def range_float(spark, d):
    return selected(spark, d, "customer", ["c_custkey", "c_acctbal"], lambda df: rel.between(df, "c_acctbal", "100,5", 900.25))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-02-01' AND DATE '1995-02-28'")
def range_date(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return df.where(rel.between(df, "day", "1995-02-01", "1995-02-28"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
def range_str(spark, d):
    return selected(spark, d, "customer", ["c_custkey", "c_mktsegment"], lambda df: rel.between(df, "c_mktsegment", "B", "G"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 45 AND 26")
def range_reversed(spark, d):
    return selected(spark, d, "orders", ["o_orderkey"], lambda df: rel.between(df, "o_custkey", 45, 26))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_returnflag <> 'R'")
def compare_ops(spark, d):
    return selected(spark, d, "lineitem", ["l_orderkey", "l_linenumber"], lambda df: rel.compare(df, "l_quantity", "<", 10) & rel.compare(df, "l_discount", ">=", 0.05) & rel.compare(df, "l_returnflag", "<>", "R"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_topk(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# ---- points

_V = "CAST(embedding AS DOUBLE[])"
_D2 = f"sqrt(({_V}[1] - {POINT[0]}) * ({_V}[1] - {POINT[0]}) + ({_V}[2] - {POINT[1]}) * ({_V}[2] - {POINT[1]}))"


@query("SELECT e.vec_id, e.label FROM embeddings e WHERE e.embedding = (SELECT embedding FROM embeddings WHERE vec_id = 7)")
def array_exact(spark, d):
    df = read(spark, d, "embeddings")
    point = df.where("vec_id = 7").first()
    return df.where(rel.equals(df, "embedding", point.embedding)).select("vec_id", "label")


@query(f"SELECT vec_id, label FROM embeddings WHERE {_D2} <= 0.1")
def near_radius(spark, d):
    return spatial.near(read(spark, d, "embeddings"), "embedding", POINT, 0.1, dims=2).select("vec_id", "label")


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, {_D2} AS x FROM embeddings ORDER BY x, vec_id LIMIT 8)")
def knn_2d(spark, d):
    return spatial.knn(read(spark, d, "embeddings"), "embedding", POINT, 8, "vec_id", dims=2).select("vec_id", "distance")


@query(f"SELECT vec_id, round(x, 6) AS distance FROM (SELECT vec_id, list_distance({_V}, (SELECT {_V} FROM embeddings WHERE vec_id = 3)) AS x FROM embeddings ORDER BY x, vec_id LIMIT 10)")
def knn_64d(spark, d):
    df = read(spark, d, "embeddings")
    return spatial.knn(df, "embedding", df.where("vec_id = 3").first().embedding, 10, "vec_id").select("vec_id", "distance")


# ---- text

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))


def _terms(table: str, key: str, column: str, stop: bool = True, stem: bool = True) -> str:
    """SQL of (key, term), a row a word."""
    word = "rtrim(w, 's')" if stem else "w"
    return f"SELECT {key}, {word} AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower(strip_accents({column})), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {table}) WHERE length(w) > 1" + (f" AND w NOT IN ({_STOP})" if stop else "")


def _index(table: str, key: str, column: str) -> str:
    return f"""t AS ({_terms(table, key, column)}), p AS (SELECT {key}, term, count(*) AS tf FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {table} WHERE {column} IS NOT NULL), w AS (SELECT {key}, term, (1 + ln(tf)) * ln((n + 1) / df) AS w FROM p JOIN f USING (term), n), m AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL)"""


def _ranked(table: str, key: str, column: str, asked: str, k: int, where: str = "") -> str:
    return f"""WITH {_index(table, key, column)}, a AS (SELECT '{asked}' AS q, 1 AS i), qt AS ({_terms("a", "i", "q")}), qp AS (SELECT term, count(*) AS tf FROM qt GROUP BY ALL),
q AS (SELECT term, (1 + ln(tf)) * ln((n + 1) / df) AS qw FROM qp JOIN f USING (term), n)
SELECT {key}, round(exact, 6) AS score FROM (SELECT {key}, round(sum(w * qw / norm) / (SELECT sqrt(sum(qw * qw)) FROM q), 12) AS exact FROM w JOIN q USING (term) JOIN m USING ({key}) WHERE norm > 0{where} GROUP BY {key} ORDER BY exact DESC, {key} LIMIT {k})"""


@query(f"SELECT term, count(*) AS n FROM ({_terms('documents', 'doc_id', 'text', stem=False)}) GROUP BY term")
def tokenize_terms(spark, d):
    return read(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n FROM ({_terms('documents', 'doc_id', 'text')}) GROUP BY term")
def stem_light(spark, d):
    return read(spark, d, "documents").select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_index('documents', 'doc_id', 'text')} SELECT doc_id, term, tf FROM p")
def term_postings(spark, d):
    return text.postings(read(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_index('documents', 'doc_id', 'text')} SELECT term, df FROM f")
def doc_freq(spark, d):
    return text.document_frequency(text.postings(read(spark, d, "documents"), "doc_id", "text"))


_WRITTEN: dict[tuple, text.TextIndex] = {}


def index_of(spark, d, name: str = "documents") -> text.TextIndex:
    """The written index of a table, made once a session and folder."""
    key = (id(spark), spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = build_index(spark, d, name)
    return _WRITTEN[key]


def build_index(spark, d, name: str) -> text.TextIndex:
    if name == "pages":
        return text.build(read(spark, d, "pages").select("page_id", text.joined(["url", "html"]).alias("body")), "page_id", "body", scratch(spark))
    return text.build(read(spark, d, name), "doc_id", "text", scratch(spark))


@query(f"WITH {_index('documents', 'doc_id', 'text')} SELECT count(*) AS postings, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs, round(sum(w / norm), 3) AS impact FROM w JOIN m USING (doc_id) WHERE norm > 0")
def text_index_build(spark, d):
    """Writes an index anew and sums up what it holds."""
    index = build_index(spark, d, "documents")
    held = index.postings.where("doc_id IS NOT NULL").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"))
    docs = index.norms.where("norm > 0").agg(F.count("doc_id").alias("docs"), F.round(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("total") / F.col("norm"))), 3).alias("impact"))
    return held.crossJoin(docs)


@query(f"WITH {_index('documents', 'doc_id', 'text')} SELECT doc_id, round(norm, 6) AS norm FROM m")
def doc_norms(spark, d):
    return index_of(spark, d).norms.select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {_index('documents', 'doc_id', 'text')} SELECT DISTINCT term FROM p")
def text_terms(spark, d):
    return index_of(spark, d).terms()


def _all_terms(asked: str) -> str:
    return f"WITH a AS (SELECT '{asked}' AS q, 1 AS i), qt AS ({_terms('a', 'i', 'q')}), t AS ({_terms('documents', 'doc_id', 'text')}) SELECT doc_id FROM t WHERE term IN (SELECT term FROM qt) GROUP BY doc_id HAVING count(DISTINCT term) = (SELECT count(DISTINCT term) FROM qt)"


@query(_all_terms(MATCH_QUERY))
def text_match_all(spark, d):
    return text.match_all(index_of(spark, d), MATCH_QUERY)


@query(_ranked("documents", "doc_id", "text", TEXT_QUERY, 10))
def text_topk(spark, d):
    return text.search(index_of(spark, d), TEXT_QUERY, 10)


@query(_ranked("(SELECT page_id, concat_ws(' ', url, html) AS body FROM pages)", "page_id", "body", "casino the reer", 10))
def text_topk_multicol(spark, d):
    return text.search(index_of(spark, d, "pages"), "casino the reer", 10)


@query(f"""WITH {_index('documents', 'doc_id', 'text')}, qp AS (SELECT item_id, term, count(*) AS tf FROM ({_terms('benchmark', 'item_id', 'text')}) GROUP BY ALL),
q AS (SELECT item_id, term, (1 + ln(tf)) * ln((n + 1) / df) AS qw FROM qp JOIN f USING (term), n), z AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(w / norm * qw / qnorm), 12) AS exact FROM w JOIN q USING (term) JOIN m USING (doc_id) JOIN z USING (item_id) WHERE norm > 0 AND qnorm > 0 GROUP BY ALL)
SELECT item_id, doc_id, round(exact, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""")
def text_search_many(spark, d):
    return text.search_many(index_of(spark, d), read(spark, d, "benchmark"), "item_id", "text", 3)


@query("SELECT * FROM (VALUES ('camión', 'camion'), ('CAMIONES', 'camione'), ('tiếng', 'tieng'), ('άλφα', 'αλφα'), ('йога', 'иога'), ('ñandúes', 'nandue'), ('x', NULL), ('los', NULL)) AS t(word, term)")
def text_accents(spark, d):
    """Words of several scripts and the terms that documents and queries have for them."""
    df = spark.createDataFrame([(w,) for w in ("camión", "CAMIONES", "tiếng", "άλφα", "йога", "ñandúes", "x", "los")], "word string")
    return df.select("word", F.get(terms(F.col("word")), F.lit(0)).alias("term"))


# Words and stems of the published sample of the Spanish stemmer.
SPANISH = "checar chec, cheques chequ, chequeo cheque, chica chic, chicos chic, chicharrones chicharron, chichimecas chichimec, torear tor, toreado tor, toreándolo tor, toreó tore, torero torer, toreros torer, tormentas torment, tornados torn, torneo torne, tornillos tornill, torno torn, toros tor, torrenciales torrencial, torrentes torrent, torreón torreon, torres torr"


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in pair.split()) + ')' for pair in SPANISH.split(', '))}) AS t(word, stem)")
def spanish_stems(spark, d):
    df = spark.createDataFrame([(pair.split()[0],) for pair in SPANISH.split(", ")], "word string")
    return df.select("word", stem(F.col("word"), "spanish").alias("stem"))


# ---- bags of descriptors: labels as objects, 16 vectors as a codebook

_BOW = """c AS (SELECT vec_id AS cw, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 16), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dd AS (SELECT vec_id, label, cw, list_distance(e.v, c.v) ^ 2 AS d2 FROM e, c), r AS (SELECT *, exp(-d2 / (2 + 1e-12)) AS k FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cw) <= 3),
a AS (SELECT label, cw, k / sum(k) OVER (PARTITION BY vec_id) AS w FROM r), b AS (SELECT label, cw, sum(w) AS w FROM a GROUP BY ALL), f AS (SELECT cw, count(*) AS df FROM b WHERE w > 0 GROUP BY ALL), n AS (SELECT count(DISTINCT label) AS n FROM b)"""


def _weights(name: str, source: str, x: str, key: str) -> str:
    return f"{name}0 AS (SELECT {key}, cw, {x} * (ln((n + 1.0) / (df + 1)) + 1) AS x FROM {source} JOIN f USING (cw), n WHERE w > 0), {name} AS (SELECT {key}, cw, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS w FROM {name}0)"


def bows(spark, d) -> DataFrame:
    df = read(spark, d, "embeddings")
    book = df.where("vec_id < 16").select(F.col("vec_id").alias("cw"), F.col("embedding").alias("centroid"))
    return similarity.soft_assign(df, book, "label", "embedding")


@query(f"WITH {_BOW} SELECT label, cw, round(w, 6) AS w FROM b")
def bow_soft_assign(spark, d):
    return bows(spark, d).select("label", "cw", F.round("w", 6).alias("w"))


@query(f"WITH {_BOW} SELECT cw, df FROM f")
def bow_df(spark, d):
    return similarity.frequency(bows(spark, d))


@query(f"WITH {_BOW}, {_weights('t', 'b', 'ln(1 + w)', 'label')} SELECT label, cw, round(w, 6) AS w FROM t")
def bow_tfidf(spark, d):
    b = bows(spark, d)
    return similarity.tfidf(b, similarity.frequency(b), b.select("label").distinct().count(), "label").select("label", "cw", F.round("w", 6).alias("w"))


_Q = "qb AS (SELECT 0 AS q, cw, w FROM b WHERE label = 3)"


@query(f"WITH {_BOW}, {_Q}, {_weights('t', 'b', 'ln(1 + w)', 'label')}, {_weights('u', 'qb', 'ln(1 + w)', 'q')}, s AS (SELECT label, sum(t.w * u.w) AS dot FROM t JOIN u USING (cw) GROUP BY ALL) SELECT label, round(x, 6) AS score FROM (SELECT label, round(coalesce(dot, 0), 12) AS x FROM (SELECT DISTINCT label FROM b) LEFT JOIN s USING (label) ORDER BY x DESC, label LIMIT 5)")
def sim_sequential(spark, d):
    b = bows(spark, d)
    return similarity.sequential(b, b.where("label = 3"), 5, "label")


@query(f"WITH {_BOW}, {_Q}, {_weights('t', 'b', 'w', 'label')}, {_weights('u', 'qb', 'w', 'q')} SELECT label, round(x, 6) AS score FROM (SELECT label, round(sum(t.w * u.w), 12) AS x FROM t JOIN u USING (cw) GROUP BY label ORDER BY x DESC, label LIMIT 5)")
def sim_inverted(spark, d):
    b = bows(spark, d)
    return similarity.inverted(b, b.where("label = 3"), 5, "label")


_INVERTED = f"WITH {_BOW}, {_Q}, {_weights('t', 'b', 'w', 'label')}, {_weights('u', 'qb', 'w', 'q')} SELECT label AS object_id, round(x, 6) AS score FROM (SELECT label, round(sum(t.w * u.w), 12) AS x FROM t JOIN u USING (cw) GROUP BY label ORDER BY x DESC, label LIMIT 5)"


@query(_INVERTED)
def media_index_search(spark, d):
    """The same search through a written index."""
    df = read(spark, d, "embeddings").select(F.col("label").alias("object_id"), F.col("vec_id").alias("desc_no"), F.col("embedding").alias("vec"))
    media = similarity.MediaIndex(spark, scratch(spark))
    media._write(df.where("desc_no < 16").select(F.col("desc_no").alias("cw"), F.col("vec").alias("centroid")), "codebook")
    media.index(df)
    return media.search(df.where("object_id = 3"), 5)


@query("SELECT label, least(count(*), 7) AS n FROM embeddings GROUP BY label")
def descriptor_sample(spark, d):
    return similarity.sample_descriptors(read(spark, d, "embeddings"), 7, "label", "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query()
def codebook_kmeans(spark, d):
    return similarity.train_codebook(read(spark, d, "embeddings"), 16, "embedding").select("cw", F.size("centroid").alias("dims"))


# ---- loading and changing rows

_RAW = "('1', '3,5', '[1, 2]'), ('-5', 'x', '3;4'), ('', 'none', ''), ('3.14', '2.50', '7'), ('null', 'NaN', '[]')"


@query(f"""WITH r(i, f, a) AS (VALUES {_RAW}), c AS (SELECT i AS raw, CASE WHEN lower(trim(i)) IN ('none', 'null', 'nan') THEN '' ELSE trim(i) END AS i, CASE WHEN lower(trim(f)) IN ('none', 'null', 'nan') THEN '' ELSE trim(f) END AS f FROM r)
SELECT raw, coalesce(try_cast(regexp_replace(i, '[^0-9]', '', 'g') AS BIGINT), 0) AS i, coalesce(try_cast(replace(f, ',', '.') AS DOUBLE), 0.0) AS f FROM c""")
def csv_clean(spark, d):
    rows = [tuple(v.strip().strip("'") for v in r.split("', '")) for r in _RAW.strip("()").split("), (")]
    df = spark.createDataFrame([(r[0].strip("'"), r[1], r[2].strip("'")) for r in rows], "i string, f string, a string")
    return df.select(F.col("i").alias("raw"), clean(F.col("i"), "INT").alias("i"), clean(F.col("f"), "FLOAT").alias("f"))


@query("SELECT * FROM (VALUES ('[1, 2]', [1, 2]::DOUBLE[]), ('3;4', []::DOUBLE[]), ('7', [7]::DOUBLE[]), ('[]', []::DOUBLE[]), ('[1, x, 2]', [1, 2]::DOUBLE[])) AS t(raw, a)")
def csv_clean_arrays(spark, d):
    df = spark.createDataFrame([("[1, 2]",), ("3;4",), ("7",), ("[]",), ("[1, x, 2]",)], "raw string")
    return df.select("raw", clean(F.col("raw"), "ARRAY").alias("a"))


# ---- statements: every row below goes through the dialect, the catalog and the engine


def engine_of(spark) -> Engine:
    return Engine(spark, scratch(spark))


def with_nation(spark, d) -> Engine:
    e = engine_of(spark)
    e.sql("CREATE TABLE nation (n_nationkey INT KEY INDEX BTREE, n_name VARCHAR[25] INDEX HASH, n_regionkey INT INDEX AVL)")
    e.load("nation", read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    return e


def with_customer(spark, d) -> Engine:
    e = engine_of(spark)
    e.sql("CREATE TABLE customer (c_custkey INT PRIMARY KEY INDEX BTREE, c_name VARCHAR, c_mktsegment VARCHAR INDEX HASH, c_acctbal FLOAT INDEX ISAM)")
    e.load("customer", read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").orderBy("c_custkey"))
    return e


def with_places(spark, d) -> Engine:
    e = engine_of(spark)
    e.sql("CREATE TABLE places (id INT KEY, spot ARRAY[FLOAT] INDEX RTREE, label INT)")
    e.load("places", read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("spot"), "label"))
    return e


def with_docs(spark, d) -> Engine:
    e = engine_of(spark)
    e.sql("CREATE TABLE docs (id INT KEY, body VARCHAR INDEX FULLTEXT, lang VARCHAR)")
    e.load("docs", read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang").orderBy("doc_id"))
    return e


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(f"{_NATION} UNION ALL VALUES (97, 'LEMURIA', 1), (98, 'MU', NULL), (99, 'ATL''ANTIS', 1)")
def insert_visible(spark, d):
    e = with_nation(spark, d)
    e.sql("INSERT INTO nation VALUES (99, 'ATL''ANTIS', 1);")
    e.sql("INSERT INTO nation (n_name, n_nationkey) VALUES ('MU', 98)")
    e.sql('INSERT INTO nation VALUES (n_nationkey=97, n_name="LEMURIA", n_regionkey=1)')
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@query(f"{_NATION} WHERE n_regionkey <> 2 AND n_nationkey NOT BETWEEN 3 AND 5")
def delete_visible(spark, d):
    e = with_nation(spark, d)
    e.sql("DELETE FROM nation")  # without a condition nothing goes
    e.sql("DELETE FROM nation WHERE n_regionkey = 2")
    e.sql("DELETE FROM nation WHERE n_nationkey BETWEEN 3 AND 5")
    return e.sql("SELECT * FROM nation")


@query(f"{_NATION}")
def sql_select_all(spark, d):
    return with_nation(spark, d).sql("SELECT * FROM nation")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sql_hash_lookup(spark, d):
    e = with_customer(spark, d)
    e.catalog.hash_out(e.database, "customer", "c_mktsegment", 4)
    return e.sql("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100.5 AND 900.25 AND c_mktsegment <> 'BUILDING' AND c_custkey >= 20")
def sql_range_and(spark, d):
    e = with_customer(spark, d)
    e.catalog.lay_out(e.database, "customer", "c_acctbal", 4)
    return e.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100.5 AND 900.25 AND c_mktsegment <> 'BUILDING' AND c_custkey >= 20")


@query("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING' AND c_acctbal < 0) AND NOT (c_custkey < 50 OR c_custkey BETWEEN 100 AND 120)")
def sql_or_not(spark, d):
    return with_customer(spark, d).sql("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING' AND c_acctbal < 0) AND NOT (c_custkey < 50 OR c_custkey BETWEEN 100 AND 120)")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7")
def sql_limit(spark, d):
    return with_customer(spark, d).sql("SELECT c_custkey, c_name FROM customer LIMIT 7")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
def sql_page_with_total(spark, d):
    page, total = with_customer(spark, d).page("customer", 5, 10)
    return page.select("c_custkey", "c_name", F.lit(total).alias("total"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1")
def fetch_by_rid(spark, d):
    e = with_nation(spark, d)
    first = e.scan("nation", 1)
    rid = e.catalog.table(e.database, "nation").agg(F.min("__rid")).first()[0]
    return e.fetch("nation", rid).select(*first.columns[:2])


@query("SELECT * FROM (VALUES ('id', 'INT', true, 'BTREE'), ('name', 'VARCHAR', false, 'AVL'), ('spot', 'ARRAY', false, 'RTREE'), ('body', 'VARCHAR', false, 'FULLTEXT')) AS t(name, kind, is_key, layout)")
def create_by_indexes(spark, d):
    e = engine_of(spark)
    e.sql("CREATE TABLE things USING INDEX btree(id), avl(name), rtree(spot), fulltext(body)")
    return spark.createDataFrame([(c.name, c.kind, c.primary, c.index) for c in e.catalog.columns(e.database, "things")], "name string, kind string, is_key boolean, layout string")


@query("SELECT * FROM (VALUES ('a', 2), ('b.c', 0)) AS t(name, row_count)")
def catalog_tables(spark, d):
    e = engine_of(spark)
    for name in ("a", "b.c", "gone"):
        e.catalog.create_table(e.database, name, [ColumnDef("id", "INT", primary=True)])
    e.catalog.drop_table(e.database, "gone")
    e.sql("INSERT INTO a VALUES (1), (2)")
    return spark.createDataFrame([(t, e.catalog.rows(e.database, t)) for t in e.catalog.tables(e.database)], "name string, row_count long")


@query(f"SELECT vec_id AS id, label FROM embeddings WHERE {_D2} <= 0.1")
def sql_near(spark, d):
    return with_places(spark, d).sql(f"SELECT id, label FROM places WHERE NEAR(spot, [{POINT[0]}, {POINT[1]}]) RADIUS 0.1")


@query(f"SELECT vec_id AS id, label FROM embeddings ORDER BY {_D2}, vec_id LIMIT 8")
def sql_knn(spark, d):
    return with_places(spark, d).sql(f"SELECT id, label FROM places WHERE KNN(spot, [{POINT[0]}, {POINT[1]}]) K 8")


@query("SELECT * FROM (VALUES (3, 0.0), (2, 0.0), (1, 0.0)) AS t(id, distance)")
def knn_under_a_millionth(spark, d):
    """Distances of 0, 1e-7 and 4e-7 in their order: the order is the row number."""
    rows = spark.createDataFrame([(1, [4e-7, 0.0]), (2, [1e-7, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id long, at array<double>")
    return spatial.knn(rows, "at", [0.0, 0.0], 3, "id").select("id", "distance")


@query(_ranked("(SELECT doc_id AS id, text AS body FROM documents)", "id", "body", TEXT_QUERY, 10))
def sql_match_topk(spark, d):
    return with_docs(spark, d).sql(f"SELECT id FROM docs WHERE body @@ '{TEXT_QUERY}' LIMIT 10")


@query(_ranked("(SELECT doc_id AS id, text AS body FROM documents)", "id", "body", TEXT_QUERY, 5, " AND id IN (SELECT doc_id FROM documents WHERE lang = 'de')"))
def sql_match_filtered(spark, d):
    return with_docs(spark, d).sql(f"SELECT id FROM docs WHERE body @@ '{TEXT_QUERY}' AND lang = 'de' LIMIT 5")


@query(f"SELECT doc_id AS id FROM ({_all_terms(MATCH_QUERY)})")
def sql_fulltext_and(spark, d):
    return with_docs(spark, d).search("docs", "body", MATCH_QUERY).select("id")


@query("SELECT * FROM (VALUES ('primary', 1), ('unstemmed', 2)) AS t(found, id)")
def fulltext_fallbacks(spark, d):
    """An index without stems: a query in the plural finds a document in the singular only by the second way."""
    docs = spark.createDataFrame([(1, "casas blancas"), (2, "una casa blanca")], "id long, body string")
    plain, light = (text.build(docs, "id", "body", scratch(spark), how) for how in ("none", "light"))
    one = text.match_any_way(plain, "casas blancas").select(F.lit("primary").alias("found"), "id")
    return one.unionAll(text.match_any_way(plain, "blancass casass").select(F.lit("unstemmed").alias("found"), "id")) if light.count else one


def csv_file(spark, lines: DataFrame, header: str) -> str:
    """One file with a header and a column of ready lines."""
    path = scratch(spark)
    first = spark.createDataFrame([(0, header)], "turn int, value string")
    both = first.unionAll(lines.select(F.lit(1).alias("turn"), F.col(lines.columns[0]).alias("value")))
    both.repartition(1).sortWithinPartitions("turn").select("value").write.text(path)
    return path


@query("SELECT n_nationkey, n_name || chr(10) || 'second line, \"quoted\"' AS n_name, n_regionkey FROM nation")
def csv_load(spark, d):
    """A CSV file with quoted commas, quotes and line breaks, loaded strictly through the engine."""
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('\nsecond line, ""quoted"""'), F.lit(","), F.col("n_regionkey").cast("string"))
    path = csv_file(spark, read(spark, d, "nation").orderBy("n_nationkey").select(line), "n_nationkey,n_name,n_regionkey")
    e = engine_of(spark)
    e.sql("CREATE TABLE nation (n_nationkey INT KEY, n_name VARCHAR, n_regionkey INT)")
    e.load_csv("nation", path)
    return e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


@query(f"SELECT vec_id, [{_V}[1], {_V}[2], {_V}[3]] AS v, label FROM embeddings")
def csv_load_arrays(spark, d):
    """Arrays quoted in the first half of a file and bare in the second."""
    v = F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 3), lambda x: x.cast("string")), ", "), F.lit("]"))
    cell = F.when(F.col("vec_id") < 500, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    path = csv_file(spark, read(spark, d, "embeddings").orderBy("vec_id").select(F.concat_ws(",", F.col("vec_id").cast("string"), cell, F.col("label").cast("string"))), "vec_id,v,label")
    return read_csv(spark, path, {"vec_id": "INT", "v": "ARRAY", "label": "INT"})


@query("SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id < 50")
def json_docs(spark, d):
    path = scratch(spark)
    read(spark, d, "documents").where("text IS NOT NULL AND doc_id < 50").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    return read_json_docs(spark, path, "text", "doc_id")


@query(_NATION)
def stream_ingest(spark, d):
    """Two runs of a stream from one checkpoint: every row arrives once."""
    e, path = engine_of(spark), scratch(spark)
    e.sql("CREATE TABLE nation (n_nationkey INT KEY, n_name VARCHAR, n_regionkey INT)")
    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        ingest(e, "nation", spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return e.sql("SELECT * FROM nation")


@query("SELECT count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def layout_statistics(spark, d):
    e = with_customer(spark, d)
    e.catalog.lay_out(e.database, "customer", "c_acctbal", 4)
    return e.catalog.layout_stats(e.database, "customer", "c_acctbal").agg(F.sum("rows").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT count(*) AS row_count, true AS read_enough, 1 AS statements FROM nation WHERE n_regionkey = 1")
def query_report(spark, d):
    e = with_nation(spark, d)
    report = e.collect("SELECT n_name FROM nation WHERE n_regionkey = 1")
    return spark.createDataFrame([(report.count, report.rows_read >= report.count and report.time_ms > 0, e.metrics.counter("statements"))], "row_count long, read_enough boolean, statements long")
