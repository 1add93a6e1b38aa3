"""Benchmark decontamination by templates.

A text becomes a template: numbers, names (capitals inside a sentence) and units (after a number) turn into typed
placeholders, all else into lower-case words.  Windows of ``WINDOW`` template tokens of every text are hash-joined
with those of the benchmark (an item of fewer tokens is one window; at most half of a window may be
placeholders).  So are windows of plain lower-case tokens, which find copies whose case or line wrapping differs and
windows rich in placeholders by their exact values, and windows of folded templates, in which a number with
``,`` or ``.`` and a run of adjacent names are one placeholder.  Windows of one item on one diagonal of a text are an occurrence: its slots are consistent
if each value of the item always stands for the same value of the text.  A text is contaminated by an
item if consistent occurrences cover ``coverage`` of the item's windows of a family: verbatim (``exact``) or with other
values (``reparameterised``).

Only DataFrame expressions.  The benchmark's windows are broadcast when there are at most
``BROADCAST_WINDOWS``; otherwise texts' windows are shuffled.  Beside a window lie
hashes and positions only, so one very long text takes as long as many short ones.

Edge cases: null and empty texts and items match nothing, nor do items of fewer than ``LEAST`` tokens; rows equal
in id and text are one; null ids are kept in results; other columns are ignored; text of one long token has no
window unless an item is as short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import save

WINDOW = 8
LEAST = 4
COVERAGE = 0.5
BROADCAST_WINDOWS = 200_000
#: Texts with a spot whose keys (16 bytes each) may be sent to every task.
BROADCAST_TEXTS = 2_000_000
#: Units of measure that count as such after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres degree degrees".split()
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: (pattern, replacement) before and after lower-casing; the same to java.util.regex and RE2.
MARK = [("[\x01-\x03]", " "), (r"([^.!?:; \t\n\r][ \t]{1,2})(\p{Lu})", f"$1{NAME}$2"), ("([0-9]+)", f" {NUMBER}$1 ")]
CLEAN = [(f"({NUMBER}[0-9]+ +)({'|'.join(sorted(UNITS, key=len, reverse=True))})([^\\p{{L}}\\p{{M}}]|$)", f"$1{UNIT}$2$3"), ("[^\\p{L}\\p{M}\\p{N}\x01-\x03]+", " "), ("^ +| +$", "")]
#: After MARK and lower-casing: the mark of digits that ``,`` or ``.`` joins to digits before them is doubled.
GROUP = (f"([0-9]) [.,] {NUMBER}", f"$1 {NUMBER}{NUMBER}")
#: Makes one token of a number's digit groups, and of adjacent names; for java.util.regex only.
FOLD = (f"({NAME}[^ ]+) (?={NAME})| (?={NUMBER}{NUMBER})", "$1")
#: Windows of words as they are, of templates, and of templates with each number and run of names as one placeholder.
FAMILIES = ("plain", "template", "folded")


def marked(text: Column) -> Column:
    """Tokens joined by blanks; those of a type begin with its mark, further digit groups of a number with two."""
    for pattern, to in MARK:
        text = F.regexp_replace(text, pattern, to)
    text = F.regexp_replace(F.lower(text), *GROUP)
    for pattern, to in CLEAN:
        text = F.regexp_replace(text, pattern, to)
    return text


def plain(mark: Column) -> Column:
    return F.regexp_replace(mark, "[\x01-\x03]+", "")


def view(mark: Column, family: str) -> Column:
    """``marked`` text as a family of windows sees it."""
    return plain(mark) if family == "plain" else F.regexp_replace(mark, *FOLD) if family == "folded" else mark


def tokens(mark: Column) -> Column:
    return F.when(F.length(mark) > 0, F.split(mark, " ")).otherwise(F.array().cast("array<string>"))


def template(values: Column) -> Column:
    return F.transform(values, lambda t: F.when(t < "\x04", F.substring(t, 1, 1)).otherwise(t))


def single(values: Column) -> Column:
    """Values of slots: a further digit group of a number is a number as any other."""
    return F.transform(values, lambda t: F.when(t.startswith(NUMBER * 2), F.substring(t, 2, 1 << 30)).otherwise(t))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though ``use`` names it inside lambda functions."""
    return F.transform(F.array(value), use)[0]


def window_key(values: Column) -> Column:
    """The hash that ``windows`` gives: that of an array is that of its elements as columns."""
    return F.xxhash64(F.transform(values, lambda t: F.xxhash64(t)))


def windows(values: Column, size: int) -> Column:
    """Hashes of all windows of tokens, each token hashed once; none if there are fewer tokens."""
    whole = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return once(F.transform(values, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(h) >= size, whole(h)).otherwise(F.array().cast("array<bigint>")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(family, item_id, bare, whole, of, at, size, key, window, values): a row for each window that counts.

    ``of`` is the number of such windows of the item in the family, ``whole`` that of its plain windows; ``bare`` items
    have no placeholder, so their plain windows are their templates' too.
    """
    out = None
    for family in FAMILIES:
        text = marked(F.coalesce("text", F.lit("")))
        n = F.size(tokens(view(text, "plain")))
        bare = ~F.exists(tokens(text), lambda x: x < "\x04")
        rows = benchmark.select("item_id", bare.alias("bare"), (n - F.least(F.lit(WINDOW), n) + 1).alias("whole"), tokens(view(text, family)).alias("v")).where(F.size("v") >= LEAST).distinct()
        if family != "plain":
            rows = rows.where(~F.col("bare"))
        rows = rows.withColumn("size", F.least(F.lit(WINDOW), F.size("v")))
        piece = lambda b, i: F.struct(i.alias("at"), F.slice(b["t"], i, F.col("size")).alias("window"), F.slice(b["v"], i, F.col("size")).alias("values"))
        parts = once(F.struct(F.col("v"), template(F.col("v")).alias("t")), lambda b: F.transform(F.sequence(F.lit(1), F.size(b["v"]) - F.col("size") + 1), lambda i: piece(b, i)))
        few = F.filter(parts, lambda p: 2 * F.size(F.filter(p["values"], lambda x: x < "\x04")) <= F.size(p["values"]))
        rows = rows.select("item_id", "bare", "whole", "size", few.alias("w")).select("item_id", "bare", "whole", "size", F.size("w").alias("of"), F.explode("w").alias("w"))
        values = F.col("w.values") if family == "folded" else single(F.col("w.values"))
        rows = rows.select(F.lit(family).alias("family"), "item_id", "bare", "whole", "of", "size", "w.at", window_key(F.col("w.window")).alias("key"), F.array_join("w.window", " ").alias("window"), values.alias("values"))
        out = rows if out is None else out.unionAll(rows)
    return out


def spots(docs: DataFrame, bench: DataFrame, kinds: list[tuple[str, int]], small: bool) -> DataFrame:
    """(doc_id, text_hash, spots) of texts with windows of equal hashes: structs of family, size, item_id, at, pos.

    Nothing but hashes and positions lies beside a window.
    """
    out = None
    for family, size in kinds:
        base = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_hash"), marked(F.col("text")).alias("mark"))
        words = tokens(plain(F.col("mark"))) if family == "plain" else template(tokens(view(F.col("mark"), family)))
        mine = bench.where((F.col("family") == family) & (F.col("size") == size)).select("key", "item_id", "at")
        rows = base.select("doc_id", "text_hash", F.posexplode(windows(words, size)).alias("pos", "key")).join(F.broadcast(mine) if small else mine, "key")
        rows = rows.select("doc_id", "text_hash", F.struct(F.lit(family).alias("family"), F.lit(size).alias("size"), "item_id", "at", "pos").alias("spot"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("doc_id", "text_hash").agg(F.collect_set("spot").alias("spots"))


def hits(docs: DataFrame, bench: DataFrame, kinds: list[tuple[str, int]], small: bool) -> DataFrame:
    """(doc_id, text_hash, family, item_id, bare, whole, of, pos, at, of the item: values, of the text: found, typed) of equal windows.

    ``typed``: the text's template is equal as well.  Only texts with a spot are marked again, once each.
    """
    where = save(spots(docs, bench, kinds, small))
    named = where.select(F.col("doc_id").alias("spot_id"), F.col("text_hash").alias("spot_hash"))
    few = where.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS  # 16 bytes each
    same_text = F.col("doc_id").eqNullSafe(F.col("spot_id")) & (F.col("text_hash") == F.col("spot_hash"))
    texts = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(F.broadcast(named) if few else named, same_text, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    at = where.select(F.col("doc_id").alias("spot_id"), F.col("text_hash").alias("spot_hash"), "spots")
    families = sorted({f for f, _ in kinds})
    held = texts.join(at, same_text).select("doc_id", "text_hash", "spots", marked(F.col("text")).alias("mark"))

    def pieces(words: Column) -> Column:
        of = lambda s: F.coalesce(*(F.when(s["family"] == f, F.slice(words[f], s["pos"] + 1, s["size"])) for f in families))
        return F.transform("spots", lambda s: F.struct(s.alias("s"), of(s).alias("found")))

    # plain windows are cut from the marked tokens too, which say whether they are typed
    every = F.struct(*(tokens(F.col("mark") if f == "plain" else view(F.col("mark"), f)).alias(f) for f in families))
    rows = held.select("doc_id", "text_hash", F.explode(once(every, pieces)).alias("p")).select("doc_id", "text_hash", "p.s.family", "p.s.item_id", "p.s.at", "p.s.pos", "p.found")
    rows = rows.join(F.broadcast(bench) if small else bench, ["family", "item_id", "at"])
    bare_words = F.transform("found", plain)
    typed = F.when(F.col("family") == "plain", bare_words).otherwise(template(F.col("found")))
    # not an equality, which would become a join key
    same = F.array_contains(F.array("window"), F.array_join(typed, " "))
    value = F.when(F.col("family") == "folded", F.col("found")).when(F.col("family") == "plain", bare_words).otherwise(single(F.col("found")))
    also = (F.col("family") != "plain") | ~F.exists("found", lambda x: x < "\x04")
    return rows.where(same).select("doc_id", "text_hash", "family", "item_id", "bare", "whole", "of", "pos", "at", "values", value.alias("found"), also.alias("typed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, kind) of each text and item that contaminates it."""
    bench = benchmark_windows(benchmark)
    kinds = {(r.family, r["size"]): r.n for r in bench.groupBy("family", "size").agg(F.count("*").alias("n")).collect()}  # WINDOW rows a family at most
    if not kinds:
        kinds = {("plain", WINDOW): 0}
    found = hits(docs, bench, sorted(kinds), sum(kinds.values()) <= BROADCAST_WINDOWS)
    item = ["doc_id", "text_hash", "family", "item_id", "bare", "whole", "of"]
    slots = F.filter(F.arrays_zip("values", "found"), lambda p: p["values"] < "\x04")
    typed = F.collect_set(F.when(F.col("typed"), F.col("at")))
    occurrence = found.groupBy(*item, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"), F.collect_set("at").alias("at"), typed.alias("typed"))
    consistent = occurrence.where(F.size(F.array_distinct(F.col("slots.values"))) == F.size("slots"))
    exact = F.forall("slots", lambda p: p["values"] == p["found"])
    covered = consistent.select(*item, exact.alias("exact"), "typed", F.explode("at").alias("at")).groupBy(*item, "at").agg(F.max("exact").alias("exact"), F.max(F.array_contains("typed", F.col("at"))).alias("typed"))
    share = covered.groupBy(*item).agg(F.count("*").alias("n"), F.count_if("typed").alias("typed"), F.min("exact").alias("exact"))
    share = share.withColumn("n", F.when(F.col("bare") & (F.col("typed") >= coverage * F.col("of")), F.col("typed")).otherwise(F.col("n"))).where(F.col("n") >= coverage * F.col("of"))
    # an item found by its template is reported by that, others by their plain windows and then by the folded template
    order = F.when(F.col("family") == "template", 0).when(F.col("family") == "plain", 1).otherwise(2)
    best = share.groupBy("doc_id", "text_hash", "item_id", "whole").agg(F.min(F.struct(order.alias("order"), (-F.round(F.col("n") / F.col("of"), 6)).alias("negative"), (~F.col("exact")).alias("other"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.negative")).alias("coverage"), F.when(F.col("best.other"), "reparameterised").otherwise("exact").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without contaminated texts."""
    bad = contaminated(docs, benchmark, coverage).select(F.col("text_hash").alias("bad_hash"), F.col("doc_id").alias("bad_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))  # whatever columns there are
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("text_hash") == F.col("bad_hash")), "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def oracle(coverage: float = COVERAGE) -> str:
    """DuckDB SQL of ``contaminated`` for items of ``WINDOW`` tokens or more."""

    def sql(s: str) -> str:
        out = "'" + s.replace("'", "''") + "'"
        for c in (NUMBER, NAME, UNIT):
            out = out.replace(c, f"' || chr({ord(c)}) || '")
        return f"({out})"

    def mark(e: str) -> str:
        for pattern, to in MARK:
            e = f"regexp_replace({e}, {sql(pattern)}, {sql(to.replace('$', chr(92)))}, 'g')"
        e = f"lower({e})"
        for pattern, to in CLEAN:
            e = f"regexp_replace({e}, {sql(pattern)}, {sql(to.replace('$', chr(92)))}, 'g')"
        return e

    plain = "list_transform(v, lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END)"
    return f"""
WITH b AS (SELECT DISTINCT item_id, string_split({mark("text")}, ' ') AS v FROM benchmark),
bw AS (SELECT item_id, i AS k, array_to_string(({plain})[i:i + {WINDOW - 1}], ' ') AS w, v[i:i + {WINDOW - 1}] AS vals FROM (SELECT *, unnest(range(1, len(v) - {WINDOW} + 2)) AS i FROM b WHERE len(v) >= {WINDOW})),
bf AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM bw WHERE 2 * len(list_filter(vals, lambda x: x < chr(4))) <= {WINDOW}),
d AS (SELECT DISTINCT doc_id, text, string_split({mark("text")}, ' ') AS v FROM documents WHERE length(text) > 0),
dw AS (SELECT doc_id, text, i AS pos, array_to_string(({plain})[i:i + {WINDOW - 1}], ' ') AS w, v[i:i + {WINDOW - 1}] AS found FROM (SELECT *, unnest(range(1, len(v) - {WINDOW} + 2)) AS i FROM d)),
h AS (SELECT doc_id, text, item_id, total, pos - k AS diagonal, k, vals, found FROM dw JOIN bf USING (w)),
s AS (SELECT doc_id, text, item_id, diagonal, unnest(vals) AS iv, unnest(found) AS dv FROM h),
ok AS (SELECT doc_id, text, item_id, diagonal, coalesce(bool_and(iv = dv) FILTER (iv < chr(4)), true) AS exact FROM s GROUP BY ALL HAVING count(DISTINCT iv) FILTER (iv < chr(4)) = count(DISTINCT (iv, dv)) FILTER (iv < chr(4))),
c AS (SELECT doc_id, text, item_id, total, k, bool_or(exact) AS exact FROM h JOIN ok USING (doc_id, text, item_id, diagonal) GROUP BY ALL)
SELECT doc_id, item_id, round(count(*) / total, 6) AS coverage, CASE WHEN bool_and(exact) THEN 'exact' ELSE 'reparameterised' END AS kind
FROM (SELECT doc_id, text, item_id, total, k, exact FROM c) GROUP BY doc_id, text, item_id, total HAVING count(*) >= {coverage} * total"""
