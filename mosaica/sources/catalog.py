"""Databases and tables as folders: a pointer beside Parquet batches.

``<root>/<user>/<database>/<table>/schema.json`` is the pointer: it names the columns and the folders that make up the
table.  Every change writes new folders first and then replaces the pointer in one rename, so readers see all of
a change or nothing, and a change that fails leaves nothing but files that no pointer names.  An append adds one folder;
a delete or a new layout writes one that stands for all.  All files go through Hadoop's file system, wherever the
root is.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaica.plans.dialect import ColumnDef

KINDS = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "DATE": T.DateType(), "VARCHAR": T.StringType(), "ARRAY": T.ArrayType(T.DoubleType())}
NAME = re.compile(r"^[A-Za-z0-9._-]+$")
RID = "__rid"
BUCKET = "__bucket"


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self.at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def write(self, path: str, text: str) -> None:
        """The whole file appears at once, in the place of one that is there: a rename that overwrites."""
        fs, p = self.at(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        target, hadoop = self.at(path)[1], self.jvm.org.apache.hadoop.fs
        option = self.gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        option[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(p.toUri(), self.conf).rename(p, target, option)

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Catalog:
    def __init__(self, spark: SparkSession, root: str, user: str = "default") -> None:
        self.spark, self.files, self.root = spark, Files(spark), f"{root.rstrip('/')}/{self.checked(user)}"

    @staticmethod
    def checked(name: str) -> str:
        if not NAME.match(name):
            raise ValueError(f"{name!r} is not a name")
        return name

    def path(self, database: str, table: str | None = None) -> str:
        return f"{self.root}/{self.checked(database)}" + (f"/{self.checked(table)}" if table else "")

    def create_database(self, database: str) -> None:
        self.files.make(self.path(database))

    def databases(self) -> list[str]:
        return self.files.names(self.root)

    def drop_database(self, database: str) -> bool:
        return self.files.delete(self.path(database))

    def tables(self, database: str) -> list[str]:
        return self.files.names(self.path(database))

    def drop_table(self, database: str, table: str) -> bool:
        return self.files.delete(self.path(database, table))

    def create_table(self, database: str, table: str, columns: list[ColumnDef], replace: bool = False) -> None:
        where, seen = self.path(database, table), [c.name for c in columns]
        if len(set(seen)) < len(seen):
            raise ValueError("a column is declared twice")
        if self.files.exists(f"{where}/schema.json"):
            if not replace:
                raise ValueError(f"table {table} exists")
            self.files.delete(where)
        self.files.make(where)
        kept = [vars(c) | {"index": c.index or ("BTREE" if c.primary or c.kind in ("INT", "DATE", "FLOAT") else None)} for c in columns]
        self.files.write(f"{where}/schema.json", json.dumps({"columns": kept, "parts": [], "next_rid": 0, "rows": 0, "streams": {}, "text": {}}))

    def meta(self, database: str, table: str) -> dict:
        try:
            return json.loads(self.files.read(self.path(database, table) + "/schema.json"))
        except FileNotFoundError:
            raise ValueError(f"no table {table} in {database}") from None

    def columns(self, database: str, table: str) -> list[ColumnDef]:
        return [ColumnDef(**c) for c in self.meta(database, table)["columns"]]

    def schema(self, database: str, table: str) -> T.StructType:
        return T.StructType([T.StructField(c.name, KINDS[c.kind], True, {"length": c.length, "primary": c.primary, "index": c.index} if c.length else {"primary": c.primary, "index": c.index}) for c in self.columns(database, table)])

    def shadows(self, database: str, table: str) -> dict[str, tuple[str, int]]:
        """Hidden columns: the first two coordinates of each RTREE column, whose ranges files know."""
        return {f"__{c.name}_{i}": (c.name, i) for c in self.columns(database, table) if c.kind == "ARRAY" and c.index == "RTREE" for i in (0, 1)}

    def shadowed(self, database: str, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: F.get(F.col(f"`{c}`"), F.lit(i)) for name, (c, i) in self.shadows(database, table).items()})

    def table(self, database: str, table: str, shadows: bool = False) -> DataFrame:
        """The current rows, with ``__rid``: a number in order of insertion; with ``shadows`` the hidden columns too."""
        meta, schema = self.meta(database, table), self.schema(database, table).add(RID, "long")
        for name in self.shadows(database, table) if shadows else ():
            schema = schema.add(name, "double")
        if not meta["parts"]:
            return self.spark.createDataFrame([], schema)
        where, dealt = self.path(database, table), (meta.get("buckets") or {}).get("part")
        rows = None  # a part that lies in buckets has folders of its own and is read by itself
        for parts in ([p for p in meta["parts"] if p != dealt], [p for p in meta["parts"] if p == dealt]):
            if parts:
                some = self.spark.read.schema(schema).parquet(*(f"{where}/{p}" for p in parts)).select(*schema.names)
                rows = some if rows is None else rows.unionAll(some)
        return rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema))

    def point(self, database: str, table: str, meta: dict) -> None:
        self.files.write(self.path(database, table) + "/schema.json", json.dumps(meta))

    def write(self, database: str, table: str, rows: DataFrame) -> tuple[str, int, int | None]:
        """A new folder with ``rows`` that no pointer names yet; how many there are, and the largest number among them."""
        name, seen = f"p{uuid.uuid4().hex}", Observation()
        self.shadowed(database, table, rows).observe(seen, F.count(F.lit(1)).alias("n"), F.max(RID).alias("high")).write.parquet(f"{self.path(database, table)}/{name}")
        found = seen.get
        return name, found.get("n") or 0, found.get("high")

    def append(self, database: str, table: str, rows: DataFrame, enforce_key: bool = False, stream: tuple[str, int] | None = None) -> int:
        """Adds rows (columns by name, coerced already) as one batch; returns how many.

        ``stream`` (name, number of the batch) makes a batch that is tried again one batch: numbers that the table has
        seen already add nothing.
        """
        meta, schema = self.meta(database, table), self.schema(database, table)
        if stream and stream[1] <= meta["streams"].get(stream[0], -1):
            return 0
        keys = [f.name for f in schema if f.metadata.get("primary")]
        missing = rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count() if keys else 0
        if missing:
            raise ValueError(f"a primary key ({', '.join(keys)}) is missing")
        if enforce_key and keys:
            both = self.table(database, table).select(*keys).unionByName(rows.select(*keys))
            if both.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ValueError("a primary key is not unique")
        cells: list[Column] = [F.substring(F.col(f"`{f.name}`"), 1, f.metadata["length"]).alias(f.name) if f.metadata.get("length") else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
        # numbers follow on from those given out: a partition's place times 2^33, above all before
        numbered = rows.select(*cells, (F.monotonically_increasing_id() + F.lit(meta["next_rid"])).alias(RID))
        name, n, high = self.write(database, table, numbered)
        streams = meta["streams"] | ({stream[0]: stream[1]} if stream else {})
        self.point(database, table, meta | {"parts": [*meta["parts"], name] if n else meta["parts"], "next_rid": high + 1 if n else meta["next_rid"], "rows": meta["rows"] + n, "streams": streams, "text": {} if n else meta["text"]})
        return n

    def rewrite(self, database: str, table: str, rows: DataFrame) -> None:
        """``rows`` become the table: one new folder, then the pointer."""
        meta = self.meta(database, table)
        name, n, _ = self.write(database, table, rows)
        self.point(database, table, meta | {"parts": [name], "rows": n, "text": {}, "buckets": None})

    def rows(self, database: str, table: str) -> int:
        """How many rows a table has, from its pointer."""
        return self.meta(database, table)["rows"]

    def delete(self, database: str, table: str, condition: Column) -> int:
        before = self.rows(database, table)
        rows = self.table(database, table)
        if rows.where(condition).limit(1).count():
            self.rewrite(database, table, rows.where(~F.coalesce(condition, F.lit(False))))
        return before - self.rows(database, table)

    def lay_out(self, database: str, table: str, column: str, files: int = 8) -> None:
        """Rows sorted and dealt by ranges of a column: row groups outside a predicate are skipped."""
        c = F.col(column)
        order = (c[0], c[1]) if isinstance(self.schema(database, table)[column].dataType, T.ArrayType) else (c,)
        self.rewrite(database, table, self.table(database, table).repartitionByRange(files, *order).sortWithinPartitions(*order, RID))

    def hash_out(self, database: str, table: str, column: str, buckets: int = 8) -> None:
        """Rows dealt to folders by a hash of a column: a look-up of a value opens the files of one bucket (``bucket_of``).

        An append leaves the buckets; until the next ``hash_out`` look-ups read all files again.
        """
        meta, where, name = self.meta(database, table), self.path(database, table), f"p{uuid.uuid4().hex}"
        rows = self.shadowed(database, table, self.table(database, table))
        bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
        rows.withColumn(BUCKET, bucket).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, column, RID).write.partitionBy(BUCKET).parquet(f"{where}/{name}")
        self.point(database, table, meta | {"parts": [name], "text": {}, "buckets": {"column": column, "count": buckets, "part": name}})

    def bucket_of(self, database: str, table: str, column: str, value: Column) -> DataFrame | None:
        """The rows of the bucket that holds ``value``, if the table lies in buckets of that column."""
        meta = self.meta(database, table)
        kept = meta.get("buckets")
        if not kept or kept["column"] != column or meta["parts"] != [kept["part"]]:
            return None
        schema = self.schema(database, table).add(RID, "long")
        number = self.spark.range(1).select(F.pmod(F.xxhash64(value.cast(schema[column].dataType)), F.lit(kept["count"])).cast("int")).first()[0]
        where = f"{self.path(database, table)}/{kept['part']}/{BUCKET}={number}"
        if not self.files.exists(where):
            return self.table(database, table).limit(0)
        return self.spark.read.schema(schema).parquet(where).select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema))

    def layout_stats(self, database: str, table: str, column: str) -> DataFrame:
        """(file, rows, low, high) of a column: what can be skipped.  One column is read."""
        return self.table(database, table).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.min(column).alias("low"), F.max(column).alias("high"))

    def vacuum(self, database: str, table: str) -> int:
        """Deletes folders that the pointer does not name; only while nobody reads or writes an older state."""
        where, meta = self.path(database, table), self.meta(database, table)
        loose = [n for n in self.files.names(where) if n not in meta["parts"] and n not in meta["text"].values()]
        return sum(self.files.delete(f"{where}/{n}") for n in loose)
