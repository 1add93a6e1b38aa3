"""Repeated passages by a sparse suffix array.

Suffixes are retained at content-selected positions: of every ``WINDOW`` neighbouring runs of ``KEY`` words the one with the least
hash.  Two equal passages of ``MIN_WORDS = WINDOW + KEY - 1`` words hold a common position with its whole run.  Suffixes
whose run occurs in one document only are dropped; the rest are sorted by run, then by the words to the right, to
the left, then by document, and each is compared with its neighbours of other documents, with
the earliest document of the stretch around it in which each suffix matches the next, and the first of its equals with
the first of the next kind.  A match is extended left and right word by word; from
``MIN_WORDS`` words on it is a repeat.  Of two matching places the one in the earlier document (by id, then position)
keeps the passage, so every passage that is cut somewhere stays somewhere.

The sort is a range partitioning with the document among its keys, so suffixes that thousands of documents share are
spread over tasks, which compare ``ROWS`` at once; a dozen rows from the ends of each piece are compared again across pieces.  Equal texts are
one document with copies, collapsed before anything else.

Edge cases: null and empty texts, and those of fewer than ``MIN_WORDS`` words, have no repeats; null ids come last in
document order; rows equal in id and text are one document; repeats inside one document alone do not count; other
columns are kept by ``cut``, whose results replace ``text`` and, if present, ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import chunks, discard, partitions, save, tidied
from mosaica.llm.hashing import signed, split_words, window_hash

MIN_WORDS = 50
WINDOW = 20
KEY = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1  # words of context on either side that can complete a passage
LAST = (1 << 63) - 1
#: Sorted suffixes (some 200 bytes each) that a task compares at once.
ROWS = 100_000

ROW = "key long, right binary, left binary, doc long, node long, pos int"
SPAN = "node long, start int, end int, removed boolean, other long"


def positions(w) -> tuple[np.ndarray, np.ndarray]:
    """(word index, run hash) of the retained suffixes of some texts."""
    runs = window_hash(w.hash, KEY)
    starts = len(w.hash) - MIN_WORDS + 1
    if starts <= 0:
        return np.zeros(0, np.int64), runs[:0]
    inside = np.flatnonzero(w.doc[:starts] == w.doc[MIN_WORDS - 1 :])
    least = np.empty(len(inside), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
    for a in range(0, len(inside), 1 << 16):
        part = inside[a : a + (1 << 16)]
        least[a : a + len(part)] = part + view[part].argmin(1)
    at = np.unique(least)
    if len(at):  # of equal runs in a row (a repeated word, say) one in each WINDOW words is enough
        same = np.concatenate([[False], (runs[at[1:]] == runs[at[:-1]]) & (at[1:] - at[:-1] < WINDOW) & (w.doc[at[1:]] == w.doc[at[:-1]])])
        begin = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        place = (at - begin) // WINDOW
        at = at[~same | (place != np.concatenate([[-1], place[:-1]]))]
    return at, runs[at]


def text_key() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")


def nodes_of(docs: DataFrame) -> DataFrame:
    """(node, t1, t2, doc, copies, text) of the different texts; doc is the smallest id."""
    rows = docs.where(F.length("text") > 0).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text", *text_key())
    return save(rows.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("text").alias("text")).withColumn("node", F.monotonically_increasing_id()))


def suffix_rows(nodes: DataFrame) -> DataFrame:
    """The suffixes whose run occurs in several texts, with the words around it."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                w = split_words(texts[a:b])
                at, run = positions(w)
                yield pa.RecordBatch.from_arrays([pa.array(signed(run)), pa.array(ids[a:b][w.doc[at]]), pa.array((at - w.first[w.doc[at]]).astype(np.int32))], ["key", "node", "pos"])

    runs = save(nodes.select("node", "text").mapInArrow(tidied(select), "key long, node long, pos int"))
    shared = runs.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    wanted = runs.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("pos", "key")).alias("at"))
    base = nodes.select("node", "doc", "text").join(wanted, "node")

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, doc, texts, at = (c.to_pylist() if i > 1 else c.to_numpy() for i, c in enumerate(batch.columns))
            for a, b in chunks(texts):
                w = split_words(texts[a:b])
                own = np.repeat(np.arange(b - a), [len(x) for x in at[a:b]])
                pos = np.array([p["pos"] for x in at[a:b] for p in x], np.int64)
                key = np.array([p["key"] for x in at[a:b] for p in x], np.int64)
                first, count = w.first[own], w.count[own]
                # a word is four bytes; 0 stands for the end of the text
                words = np.concatenate([(w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(1, np.uint32)])
                sides = []
                for step in (KEY + np.arange(SIDE), -1 - np.arange(SIDE)):
                    place = pos[:, None] + step[None, :]
                    ok = (place >= 0) & (place < count[:, None])
                    sides.append(words[np.where(ok, first[:, None] + place, len(words) - 1)].astype(">u4"))
                cells = [pa.array([r.tobytes() for r in s], pa.binary()) for s in sides]
                yield pa.RecordBatch.from_arrays([pa.array(key), *cells, pa.array(doc[a:b][own]), pa.array(node[a:b][own]), pa.array(pos.astype(np.int32))], ["key", "right", "left", "doc", "node", "pos"])

    out = save(base.select("node", "doc", "text", "at").mapInArrow(tidied(surround), ROW))
    discard(runs)
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from the start; the end of a text equals nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def neighbours(rows: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """Repeats between sorted suffixes, and the indexes of rows that the next partition may need."""
    key, doc, node, pos = (rows[c].to_numpy() for c in ("key", "doc", "node", "pos"))
    n = len(key)
    right, left = (np.frombuffer(b"".join(rows[c].to_pylist()), ">u4").reshape(n, SIDE) for c in ("right", "left"))
    index = np.arange(n)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_kind = new_key | np.concatenate([[True], (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1)])
    new_node = new_key | np.concatenate([[True], node[1:] != node[:-1]])
    begin = np.maximum.accumulate(np.where(new_node, index, 0))  # of the row's stretch of one document
    after = np.minimum.accumulate(np.where(np.concatenate([new_node[1:], [True]]), index, n)[::-1])[::-1] + 1
    heads = np.flatnonzero(new_kind)
    # stretches in which each row matches the next, and their earliest rows: before, behind and anywhere
    joined = (~new_key[1:]) & (common(left[1:], left[:-1]) + KEY + common(right[1:], right[:-1]) >= MIN_WORDS)
    stretch = np.concatenate([np.zeros(min(n, 1), np.int64), np.cumsum(~joined)])
    by_age = np.lexsort((pos, node, doc))
    age = np.empty(n, np.int64)
    age[by_age] = index
    before = by_age[np.minimum.accumulate(age + (n - stretch) * n) % n] if n else index
    behind = by_age[np.minimum.accumulate((age + stretch * n)[::-1])[::-1] % n] if n else index
    earliest = np.where(age[before] < age[behind], before, behind)
    pairs = [(index, begin - 1), (index, after), (heads[1:], heads[:-1]), (heads[:-1], heads[1:]), (index, before), (index, behind), (index, earliest)]
    spans: list[np.ndarray] = []
    for x, y in pairs:
        fine = (y >= 0) & (y < n)
        x, y = x[fine], y[fine]
        fine = (key[x] == key[y]) & (node[x] != node[y])
        x, y = x[fine], y[fine]
        lo, hi = common(left[x], left[y]), common(right[x], right[y])
        fine = lo + KEY + hi >= MIN_WORDS
        x, y, lo, hi = x[fine], y[fine], lo[fine], hi[fine]
        later = (doc[x] > doc[y]) | (doc[x] == doc[y]) & (node[x] > node[y])
        spans.append(np.stack([node[x], pos[x] - lo, pos[x] + KEY + hi, later, doc[y]]).astype(np.int64))
    found = np.unique(np.concatenate(spans, axis=1), axis=1) if n else np.zeros((5, 0), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(bool)), pa.array(found[4])], ["node", "start", "end", "removed", "other"])
    stretches = np.flatnonzero(new_node)
    ends = {0, n - 1, *stretches[1:2], heads[-1], *heads[1:2], max(0, stretches[-1] - 1), earliest[0], earliest[-1]} if n else set()
    return batch, np.array(sorted(ends), np.int64)


def repeats(rows: DataFrame) -> DataFrame:
    """(node, start, end, removed, other) of all repeats among ``suffix_rows``."""
    order = ["key", "right", "left", "doc", "node", "pos"]
    kinds = {"key": pa.int64(), "right": pa.binary(), "left": pa.binary(), "doc": pa.int64(), "node": pa.int64(), "pos": pa.int32()}
    names = {"start": pa.int32(), "end": pa.int32(), "removed": pa.bool_(), "other": pa.int64()}

    limit = ROWS

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, limit):
                held.append(batch.slice(a, limit))
                if sum(len(b) for b in held) >= limit:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in pieces(batches):
            found, ends = neighbours(every)
            k = len(found)
            yield pa.RecordBatch.from_arrays([found["node"] if c == "node" else pa.nulls(k, t) for c, t in kinds.items()] + [found[c] for c in names], [*kinds, *names])
            some = every.take(pa.array(ends)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([some[c] for c in kinds] + [pa.nulls(len(some), t) for t in names.values()], [*kinds, *names])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield neighbours(pa.Table.from_batches(held))[0]

    made = save(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(tidied(run), f"{ROW}, start int, end int, removed boolean, other long"))
    spans = made.where("key is null").select("node", "start", "end", "removed", "other")
    edges = made.where("key is not null").select(*order).coalesce(1).sortWithinPartitions(*order)  # a dozen of every ROWS rows
    return spans.unionAll(edges.mapInArrow(tidied(across), SPAN))


def merged(spans: DataFrame) -> DataFrame:
    """(node, start, end, kept, other): passages of a text without overlap; those not kept are to be cut."""

    def join(parts: list[tuple[int, int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for start, end, other in sorted(parts):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
                out[-1][2] = min(out[-1][2], other)
            else:
                out.append([start, end, other])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = join([(s["start"], s["end"], s["other"]) for s in spans if s["removed"]])
                rows += [(node, *x[:2], False, x[2]) for x in cut]
                for start, end, other in join([(s["start"], s["end"], s["other"]) for s in spans if not s["removed"]]):
                    for a, b, _ in cut:  # what is left of a kept passage outside of cut ones
                        if a < end and b > start:
                            if a > start:
                                rows.append((node, start, a, True, other))
                            start = max(start, b)
                    if start < end:
                        rows.append((node, start, end, True, other))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], ["node", "start", "end", "kept", "other"])

    return spans.groupBy("node").agg(F.collect_set(F.struct("start", "end", "removed", "other")).alias("spans")).mapInArrow(tidied(run), "node long, start int, end int, kept boolean, other long")


def word_counts(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [split_words(texts[a:b]).count for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n).astype(np.int32) if n else [], pa.int32())], ["node", "n_words"])

    return nodes.select("node", "text").mapInArrow(tidied(run), "node long, n_words int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, kept, other_doc_id): the repeated passages of every document.

    ``kept`` marks the place where a passage stays; ``other_doc_id`` is the smallest id found for it elsewhere.
    """
    nodes = nodes_of(docs)
    passages = merged(repeats(suffix_rows(nodes))).join(nodes.select("node", "doc"), "node").select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "kept", F.col("other").alias("other_doc_id"))
    copied = nodes.where("copies > 1")
    copied = copied.select("node", "t1", "t2", "doc").join(word_counts(copied), "node").where(F.col("n_words") >= MIN_WORDS)
    ids = docs.where(F.length("text") > 0).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), *text_key()).distinct()
    copies = ids.join(copied.select("t1", "t2", F.col("doc").alias("other_doc_id"), "n_words"), ["t1", "t2"]).where("doc_id <> other_doc_id")
    whole = copies.select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.lit(False).alias("kept"), "other_doc_id")
    first = copies.groupBy(F.col("other_doc_id").alias("doc_id"), F.col("n_words").alias("end_word")).agg(F.min("doc_id").alias("other_doc_id")).select("doc_id", F.lit(0).alias("start_word"), "end_word", F.lit(True).alias("kept"), "other_doc_id")
    out = passages.unionByName(whole).unionByName(first)
    real = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(real("doc_id"), "start_word", "end_word", "kept", real("other_doc_id"))


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut but for one place each; documents of which nothing is left go."""
    nodes = nodes_of(docs)
    gone = merged(repeats(suffix_rows(nodes))).where("not kept").groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    parts = nodes.select("node", "t1", "t2", F.col("doc").alias("first")).join(gone, "node", "left").where("cut is not null").drop("node").unionByName(nodes.where("copies > 1").select("t1", "t2", F.col("doc").alias("first"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("cut")))
    parts = parts.groupBy("t1", "t2").agg(F.min("first").alias("first"), F.first("cut", ignorenulls=True).alias("cut"))
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            spans, later = batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()
            keep = []
            for i, text in enumerate(texts):
                if not text or not (spans[i] or later[i]):
                    keep.append(True)
                    continue
                w = split_words([text])
                if later[i] and w.count[0] >= MIN_WORDS:
                    keep.append(False)
                    continue
                raw, left, at = text.encode(), [], 0
                for s in sorted(spans[i] or [], key=lambda s: s["start"]):
                    left.append(raw[at : w.start[s["start"]]])
                    at = w.start[s["end"]] if s["end"] < w.count[0] else len(raw)
                texts[i] = b"".join([*left, raw[at:]]).decode()
                keep.append(bool(texts[i].strip()))
            made = list(batch.columns[: len(columns)])
            made[columns.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                old = batch.column(columns.index("n_chars")).to_pylist()
                made[columns.index("n_chars")] = pa.array([len(t) if (s or x) and t is not None else n for t, s, x, n in zip(texts, spans, later, old, strict=True)], made[columns.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(made, columns).filter(pa.array(keep, pa.bool_()))

    place = {c: f"c{i}" for i, c in enumerate(columns)}  # names that no column of ours has
    mine = docs.select(*(F.col(c).alias(place[c]) for c in columns), *text_key())
    rows = mine.join(parts, ["t1", "t2"], "left")
    later = F.col("first").isNotNull() & (F.coalesce(F.col(place["doc_id"]).cast("long"), F.lit(LAST)) != F.col("first"))
    return rows.select(*place.values(), "cut", F.coalesce(later, F.lit(False)).alias("later")).mapInArrow(tidied(run), schema)
