"""CSV tables: sniffed separators, projection onto a schema, strict or lenient values."""

from __future__ import annotations

import csv as sniffing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff(sample: str) -> str:
    """The separator of the first lines; a comma if that cannot be told."""
    try:
        return sniffing.Sniffer().sniff(sample[:10_000], delimiters=",;\t|").delimiter
    except sniffing.Error:
        return ","


def clean(value: Column, kind: str) -> Column:
    """A lenient value: words for nothing are empty; integers keep their digits only; bad numbers are 0."""
    v = F.trim(F.coalesce(value, F.lit("")))
    v = F.when(F.lower(v).isin("none", "null", "nan"), F.lit("")).otherwise(v)
    if kind == "INT":
        return F.coalesce(F.regexp_replace(v, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind == "FLOAT":
        return F.coalesce(F.regexp_replace(v, ",", ".").try_cast("double"), F.lit(0.0))
    if kind == "ARRAY":
        return F.filter(F.transform(elements(v), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    if kind == "DATE":
        return F.try_to_timestamp(v, F.lit("yyyy-M-d")).cast("date")
    return v


def strict(value: Column, kind: str) -> Column:
    """A value that must fit its type; what does not fit is null here and counted by ``read_csv``."""
    v = F.trim(value)
    if kind == "INT":
        return v.try_cast("bigint")
    if kind == "FLOAT":
        return F.regexp_replace(v, ",", ".").try_cast("double")
    if kind == "DATE":
        return F.try_to_timestamp(v, F.lit("yyyy-M-d")).cast("date")
    if kind == "ARRAY":
        parts = elements(v)
        return F.when(F.forall(parts, lambda x: x.try_cast("double").isNotNull()), F.transform(parts, lambda x: x.try_cast("double")))
    return F.coalesce(value, F.lit(""))


def elements(value: Column) -> Column:
    """The parts of an array's text, blank ones left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


#: A record: all to a line break that no quotes hold.
RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?)++'
#: A bracketed list outside quotes, or a quoted cell (which stays as it is).
LIST = r'("(?:[^"]++|"")*+")|(\[[^\]"\r\n]*\])'


def records(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """(value, header): the records of every file, the first of each marked.

    With ``multiline`` quotes may hold line breaks and a file is one task's, as a quote anywhere decides what follows.
    Without, lines are records and large files are split; a header is then told by its place in the file.
    """
    if multiline:
        found = F.regexp_extract_all("value", F.lit(RECORD), F.lit(0))
        return spark.read.text(path, wholetext=True).select(F.posexplode(found).alias("at", "value")).select("value", (F.col("at") == 0).alias("header"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(F.length("value") > 0)
    first = lines.where("block = 0").groupBy("file").agg(F.min("line").alias("line"))  # a row a file
    return lines.join(F.broadcast(first.select("line", F.lit(True).alias("header"))), "line", "left").select("value", F.coalesce("header", F.lit(False)).alias("header"))


def read_csv(spark: SparkSession, path: str, kinds: dict[str, str], lengths: dict[str, int] | None = None, lenient: bool = False, separator: str | None = None, multiline: bool = True) -> DataFrame:
    """Columns of ``kinds`` (name: INT, FLOAT, DATE, VARCHAR, ARRAY) from files with a header.

    Columns beyond them are ignored, missing ones are null.  In strict mode a value that does not fit fails the
    query when it is read.  If ``kinds`` has an ARRAY, any array may stand unquoted in brackets, whatever the
    separator and wherever in the file.  Only the separator and the names are taken from the first lines.
    """
    head = [r.value for r in spark.read.text(path).where(F.length("value") > 0).limit(20).collect()]
    if not head:
        raise ValueError("the file is empty")
    sep = separator or sniff("\n".join(head))
    names = [n.strip() for n in next(sniffing.reader([head[0].lstrip("\ufeff")], delimiter=sep))]
    value = F.col("value")
    if "ARRAY" in kinds.values():
        value = F.regexp_replace(F.regexp_replace(value, LIST, '$1\x01$2\x02'), '\x01(\\[[^\x02]*)\x02', '"$1"')
        value = F.regexp_replace(value, "[\x01\x02]", "")
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    raw = records(spark, path, multiline).where("NOT header").select(F.from_csv(value, F.lit(schema), options).alias("r")).select("r.*")
    out = []
    for name, kind in kinds.items():
        if name not in raw.columns:
            out.append(F.lit(None).cast({"INT": "bigint", "FLOAT": "double", "DATE": "date", "ARRAY": "array<double>"}.get(kind, "string")).alias(name))
            continue
        c = F.col(f"`{name}`")
        v = clean(c, kind) if lenient else strict(c, kind)
        if not lenient and kind != "VARCHAR":
            v = F.when(v.isNull() & (F.length(F.trim(c)) > 0), F.raise_error(F.concat(F.lit(f"{name}: not {kind}: "), c)).cast({"INT": "bigint", "FLOAT": "double", "DATE": "date", "ARRAY": "array<double>"}[kind])).otherwise(v)
        if lengths and name in lengths:
            v = F.substring(v, 1, lengths[name])
        out.append(v.alias(name))
    return raw.select(*out)


def read_json_docs(spark: SparkSession, path: str, text: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, text) of JSON documents: a line each, or files that hold one list or object.

    A document is an object with the text under ``text``, or a bare string; without a ``key`` documents are numbered by
    file and place.  Objects without the text have a null one.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    whole = F.from_json("value", F.lit("array<string>"))
    each = F.when(F.col("value").startswith("["), whole).otherwise(F.filter(F.split("value", r"\r?\n(?=[\[{\"])"), lambda x: F.length(F.trim(x)) > 0))
    docs = lines.select("file", F.posexplode(each).alias("at", "doc"))
    is_object = F.trim("doc").startswith("{")
    own = F.when(is_object, F.get_json_object("doc", f"$.{text}")).otherwise(F.regexp_replace(F.col("doc"), '^"|"$', ""))
    number = F.get_json_object("doc", f"$.{key}") if key else F.concat_ws("#", F.regexp_extract("file", "[^/]*$", 0), F.col("at").cast("string"))
    return docs.select(number.alias("doc_id"), own.alias("text"))
