"""The engine: SQL text and verbs over a catalog's tables, all as DataFrames."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.operators import relational as rel
from mosaica.operators import spatial, text
from mosaica.plans import dialect
from mosaica.plans.metrics import Metrics, plan_rows
from mosaica.sources.catalog import KINDS, RID, Catalog
from mosaica.sources.csv import read_csv, read_json_docs

DEFAULT_K = 10


@dataclass
class QueryReport:
    rows: list[dict]
    count: int
    time_ms: float
    files: int
    rows_read: int = 0
    operators: list[tuple[str, int]] | None = None  # the plan's operators and the rows that each gave


def coerce(kind: str, value: Any) -> Any:
    """A literal as a value of a column type; null stays null."""
    if value is None:
        return None
    if kind == "INT":
        return int(value)
    if kind == "FLOAT":
        return float(value.replace(",", ".")) if isinstance(value, str) else float(value)
    if kind == "DATE":
        return value if isinstance(value, datetime.date) else datetime.date(*map(int, str(value).split("-")))
    if kind == "ARRAY":
        if isinstance(value, str):
            value = [x for x in value.strip().strip("[]").split(",") if x.strip()]
        return [float(x) for x in value]
    return str(value)


class Engine:
    def __init__(self, spark: SparkSession, root: str, database: str = "main", user: str = "default") -> None:
        self.spark, self.catalog, self.database = spark, Catalog(spark, root, user), database
        self.catalog.create_database(database)
        self.metrics = Metrics()

    # ---- SQL

    def sql(self, statement: str) -> DataFrame | dict:
        """Rows of a SELECT as a DataFrame; what another statement did as a dict."""
        node = dialect.parse(statement)
        if isinstance(node, dialect.Create):
            self.catalog.create_table(self.database, node.table, node.columns)
            return {"created": node.table}
        if isinstance(node, dialect.Insert):
            return {"inserted": self.insert(node.table, [self.row(node.table, r, node.columns) for r in node.rows])}
        if isinstance(node, dialect.Delete):
            return {"deleted": self.delete(node.table, node.where)}
        return self.select(node)

    def row(self, table: str, values: list, columns: list[str] | None) -> dict:
        own = self.catalog.columns(self.database, table)
        names = columns or [c.name for c in own]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for {len(names)} columns")
        unknown = set(names) - {c.name for c in own}
        if unknown:
            raise ValueError(f"unknown column {sorted(unknown)[0]}")
        return dict(zip(names, values, strict=True))

    def select(self, node: dialect.Select) -> DataFrame:
        df, kept, limit = self.catalog.table(self.database, node.table, shadows=True), node.columns, node.limit
        plain = [p for p in node.where if p.op not in ("MATCH", "KNN")]
        ranked = [p for p in node.where if p.op in ("MATCH", "KNN")]
        if len(ranked) > 1:
            raise dialect.SQLError("one ranked condition at most")
        for p in plain:
            if p.op == "=" and len(node.where) == 1 and (rows := self.bucket(node.table, p, df)) is not None:
                df = rows
            df = df.where(self.condition(df, p))
        order = [F.col(RID)]
        if ranked and ranked[0].op == "MATCH":
            hits = text.scores(self.text_index(node.table, [ranked[0].column]), ranked[0].value)  # filtered first, ranked then
            df, order = df.join(hits, RID), [F.desc("exact"), F.col(RID)]
            limit = DEFAULT_K if limit is None else limit
        elif ranked:
            df = spatial.knn(df, ranked[0].column, ranked[0].value, int(ranked[0].extra))
            order = []  # in order already, by the exact distance
        elif any(p.op == "BETWEEN" for p in plain):
            order = [F.col(next(p.column for p in plain if p.op == "BETWEEN")), F.col(RID)]
        df = df.orderBy(*order) if order else df
        if limit is not None:
            df = df.limit(limit)
        if ranked and ranked[0].op == "MATCH":
            df = df.withColumn("score", F.round("exact", text.SHOWN)).drop("exact")
            kept = kept and [*kept, "score"]
        return df.select(*kept) if kept else df.drop(RID, "distance", *self.catalog.shadows(self.database, node.table))

    def bucket(self, table: str, p: dialect.Predicate, df: DataFrame) -> DataFrame | None:
        """The rows of the one bucket that can hold a value, if the table lies in buckets of the column."""
        return self.catalog.bucket_of(self.database, table, p.column, rel.literal(df, p.column, p.value)) if p.value is not None else None

    @staticmethod
    def coordinates(df: DataFrame, column: str) -> list[str]:
        """The hidden columns that hold the coordinates of a column, if ``df`` has them."""
        return [name for name in (f"__{column}_0", f"__{column}_1") if name in df.columns]

    def condition(self, df: DataFrame, p: dialect.Predicate) -> Column:
        if p.op in ("OR", "NOT"):
            every = lambda ps: reduce(lambda a, b: a & b, (self.condition(df, x) for x in ps))
            return reduce(lambda a, b: a | b, map(every, p.value)) if p.op == "OR" else ~every(p.value)
        if p.op == "NEAR":
            return spatial.within(p.column, p.value, float(p.extra), scalars=self.coordinates(df, p.column))
        if p.op in ("MATCH", "KNN"):
            raise dialect.SQLError("a ranked condition can only be joined by AND")
        return rel.between(df, p.column, p.value, p.extra) if p.op == "BETWEEN" else rel.compare(df, p.column, p.op, p.value)

    def collect(self, statement: str, limit: int = 100_000) -> QueryReport:
        """The rows of a statement (at most ``limit`` of them; ``run`` writes larger results) and what it took."""
        with self.metrics.timer("statement") as spent:
            df = self.sql(statement)
            df = df if isinstance(df, dict) else df.limit(limit)
            rows = [df] if isinstance(df, dict) else [r.asDict() for r in df.collect()]
        self.metrics.inc("statements")
        if isinstance(df, dict):
            return QueryReport(rows, next((v for v in df.values() if isinstance(v, int)), 0), spent.ms, 0)
        operators = plan_rows(df)
        read = sum(n for name, n in operators if name.startswith(("Scan", "LocalTableScan")))
        self.metrics.inc("rows read", read)
        return QueryReport(rows, len(rows), spent.ms, len(df.inputFiles()), read, operators)

    def run(self, statement: str, path: str) -> None:
        """Writes the rows of a SELECT as Parquet, whatever their number."""
        self.sql(statement).write.mode("overwrite").parquet(path)

    # ---- verbs

    def insert(self, table: str, rows: list[dict]) -> int:
        own = self.catalog.columns(self.database, table)
        data = [tuple(coerce(c.kind, r.get(c.name)) for c in own) for r in rows]
        schema = ", ".join(f"`{c.name}` {KINDS[c.kind].simpleString()}" for c in own)
        return self.load(table, self.spark.createDataFrame(data, schema).coalesce(1))

    def load(self, table: str, rows: DataFrame, stream: tuple[str, int] | None = None) -> int:
        with self.metrics.timer("load"):
            n = self.catalog.append(self.database, table, rows, stream=stream)
        self.metrics.inc("rows loaded", n)
        return n

    def load_csv(self, table: str, path: str, lenient: bool = False, index: bool = True) -> int:
        """Loads files and then builds the index of each FULLTEXT column."""
        own = self.catalog.columns(self.database, table)
        n = self.load(table, read_csv(self.spark, path, {c.name: c.kind for c in own}, {c.name: c.length for c in own if c.length}, lenient))
        for c in own:
            if index and c.index == "FULLTEXT":
                self.text_index(table, [c.name])
        return n

    def load_json_docs(self, table: str, path: str, text_column: str = "text", key_column: str = "doc_id", text_field: str = "text", key_field: str | None = None) -> int:
        docs = read_json_docs(self.spark, path, text_field, key_field)
        own = [c.name for c in self.catalog.columns(self.database, table)]
        named = {key_column: F.col("doc_id"), text_column: F.col("text")}
        return self.load(table, docs.select(*(named.get(c, F.lit(None)).alias(c) for c in own)))

    def delete(self, table: str, where: list[dialect.Predicate]) -> int:
        """Without a condition nothing is deleted."""
        if not where:
            return 0
        df, condition = self.catalog.table(self.database, table), F.lit(True)
        for p in where:
            condition = condition & self.condition(df, p)
        return self.catalog.delete(self.database, table, condition)

    def scan(self, table: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return rel.page(self.catalog.table(self.database, table), [RID], limit, offset).drop(RID)

    def page(self, table: str, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
        """A page in order of insertion, and the number of rows of the table (from its pointer)."""
        return self.scan(table, limit, offset), self.catalog.rows(self.database, table)

    def fetch(self, table: str, rid: int) -> DataFrame:
        return self.catalog.table(self.database, table).where(F.col(RID) == rid)

    def search(self, table: str, column: str, value: Any) -> DataFrame:
        """Rows of a value; on a FULLTEXT column, rows that hold all its words."""
        df = self.catalog.table(self.database, table)
        if df.schema[column].metadata.get("index") == "FULLTEXT":
            return df.join(text.match_any_way(self.text_index(table, [column]), value), RID, "left_semi").orderBy(RID).drop(RID)
        rows = self.bucket(table, dialect.Predicate(column, "=", value), df)
        df = df if rows is None else rows
        return df.where(rel.equals(df, column, value)).orderBy(RID).drop(RID)

    def range(self, table: str, column: str, low: Any, high: Any) -> DataFrame:
        df = self.catalog.table(self.database, table)
        return df.where(rel.between(df, column, low, high)).orderBy(column, RID).drop(RID)

    def near(self, table: str, column: str, point: list[float], radius: float) -> DataFrame:
        df = self.catalog.table(self.database, table, shadows=True)
        rows = spatial.near(df, column, point, radius, scalars=self.coordinates(df, column)).orderBy(RID)
        return rows.drop(RID, *self.catalog.shadows(self.database, table))

    def knn(self, table: str, column: str, point: list[float], k: int = 1) -> DataFrame:
        return spatial.knn(self.catalog.table(self.database, table), column, point, k).drop(RID)

    # ---- full text

    def text_index(self, table: str, columns: list[str], how: str = "light") -> text.TextIndex:
        """The index of a table's columns: written when first asked for and after changes, found by any engine."""
        meta, name = self.catalog.meta(self.database, table), json.dumps([columns, how])
        where = self.catalog.path(self.database, table)
        if name in meta["text"]:
            return text.load(self.spark, f"{where}/{meta['text'][name]}", RID)
        rows, joined = self.catalog.table(self.database, table), text.joined(columns)
        if len(columns) > 1:
            rows = rows.where(F.length(F.trim(joined)) > 0)
        folder = f"_text_{uuid.uuid4().hex}"
        with self.metrics.timer("text index"):
            made = text.build(rows, RID, joined if len(columns) > 1 else F.col(columns[0]), f"{where}/{folder}", how)
        now = self.catalog.meta(self.database, table)
        if now["parts"] == meta["parts"]:  # of the rows that it was built from
            self.catalog.point(self.database, table, now | {"text": now["text"] | {name: folder}})
        return made

    def text_search(self, table: str, columns: list[str], query: str, k: int = DEFAULT_K) -> DataFrame:
        if not 1 <= k <= 1000:
            raise ValueError("k is 1 to 1000")
        hits = text.scores(self.text_index(table, columns), query).orderBy(F.desc("exact"), RID).limit(k)
        rows = hits.join(self.catalog.table(self.database, table), RID).orderBy(F.desc("exact"), RID)
        return rows.withColumn("score", F.round("exact", text.SHOWN)).drop("exact")

    def text_terms(self, table: str, columns: list[str]) -> DataFrame:
        """The terms of an index in order."""
        return self.text_index(table, columns).terms()
