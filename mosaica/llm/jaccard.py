"""Exact Jaccard self-join of shingle sets by a size-aware heavy-light plan.

A document is the set of its distinct word shingles; equal sets are one node.  Two nodes link when
``100 * common >= percent * union``.  Candidate pairs meet on keys:

* light: a set of at most ``boundary`` shingles (or one that can link with such a set) enumerates its subsets of each
  size that a partner of some size must share with it;
* heavy: any other set is posted in the inverted lists of its first ``n - ceil(percent n) + 1`` shingles in an order that
  puts frequent shingles last, and its lists are scanned.

``boundary`` minimises subsets enumerated plus list entries scanned, from the histogram of sizes and the lengths of
the lists.  Frequencies come from counts inside partitions, kept in a table of fixed size; as any order is
right, they steer cost alone.

Lists are not expanded into pairs.  First each member is compared with its list's centre (the member whose shingles
are most frequent: of an original and its edited copies, the original).  In lists whose other members are then still in
several components, those outside the largest one are compared with all of other components: pair by pair in short
lists; in long ones dealt into parts of ``OUTSIDE`` outsiders and ``MEMBERS`` members, so that no key is one task's.  Every
pair that shares a key is so compared or is in one component already; no list is cut, so no link between different
sets is lost from the components.

A pair is compared in two steps.  A set's sketch has the parity of its shingles in each of four to eight slots a shingle:
two sketches differ in no more bits than the sets in shingles, so a pair whose sketches differ in too many has no link,
and its texts are never sent.  All others are verified by their whole sets.  A part of a long list gives a spanning
forest of the components that its sketches join; if one of its edges turns out to be none, the part is compared again,
at last with all its pairs.

Edge cases: a text without words is linked with nothing and is its own component; one of fewer words than a
shingle is one shingle; null ids take part but name a component only if it has no other (then null); repeated rows are
equal sets; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import discard, save, text_chunks, tidied
from mosaica.llm.components import Forest, components
from mosaica.llm.hashing import grams, mix, signed, split_words

#: Slots of the frequency table (a byte each, sent to every worker).
SLOTS = 1 << 22
#: Jobs that bring it to the driver at most.
FETCHES = 8
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Largest set that may be enumerated.
LARGEST_LIGHT = 24
#: Lists of at most so many members are compared pair by pair; a pair that many lists share is compared once.
SHORT = 64
#: Outsiders and members of a long list that one task compares.
OUTSIDE = 2048
MEMBERS = 1 << 16
#: Rounds of spanning forests before all pairs are given.
FORESTS = 1
#: Bits of the largest sketch; a set of more shingles has a coarser one.
SKETCH = 1 << 20
#: Bits of a node's id below its rank among centres.
NODE_BITS = 50
#: 64-bit words that are compared at once.
WORDS = 1 << 21


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = split_words(texts)
    h = grams(w.hash, width)
    out = []
    for first, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(h[first : first + n - width + 1]))
        elif n:
            out.append(grams(w.hash[first : first + n], n) ^ np.uint64(n))
        else:
            out.append(h[:0])
    return out


def each(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, part in text_chunks(texts):
        yield from shingle_sets(part, width)


def least_common(s: int, t: int, percent: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(s: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of ``s`` enumerates to meet any partner, one of the two being light."""
    fits = range(-(-percent * s // 100), s * 100 // percent + 1)
    return sorted({least_common(s, t, percent) for t in fits if min(s, t) <= boundary} - {0})


def subset_cost(s: int, boundary: int, percent: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s, boundary, percent) if c <= s)


def choose_boundary(sizes: dict[int, int], scan: dict[int, float], percent: int) -> int:
    """The boundary of least cost: subsets of light sets (and partners) plus list entries of heavy ones."""

    def cost(x: int) -> float:
        return sum(n * subset_cost(s, x, percent) for s, n in sizes.items() if s * percent <= 100 * x) + sum(n * scan.get(s, 0.0) for s, n in sizes.items() if s > x)

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def keys_of(own: np.ndarray, level: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    n, out = len(own), []
    if n * percent <= 100 * boundary:
        spread = mix(own)
        for c in subset_sizes(n, boundary, percent):
            if c <= n:
                # a subset of c is the whole without n - c: sums make its hash cheap
                left = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
                out.append(mix(spread.sum() - spread[left].sum(1, dtype=np.uint64) + np.uint64(c)))
    if n > boundary:
        out.append(own[np.lexsort((own, level))[: prefix_length(n, percent)]])
    return np.concatenate(out) if out else own[:0]


def sketch(own: np.ndarray) -> bytes:
    """The parity of a set's shingles in each slot; the number of slots is a power of two."""
    size = min(SKETCH, 1 << max(6, (8 * len(own)).bit_length() - 1))
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of as many 64-bit words, from rows of as many or twice, four times ... as many."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets of these sizes can differ in, -1 if none of these sizes link."""
    least = -(-percent * (n + m) // (100 + percent))
    return np.where(least <= np.minimum(n, m), n + m - 2 * least, -1)


def may_link(n: np.ndarray, left: list[bytes], m: np.ndarray, right: list[bytes], percent: int) -> np.ndarray:
    """Whether the sketches of each pair leave a link possible."""
    out = np.zeros(len(n), bool)
    limit = allowed(n, m, percent)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    for x, y in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == x) & (sizes[:, 1] == y) & (limit >= 0))
        words = int(min(x, y)) // 8
        step = max(1, WORDS // (int(max(x, y)) // 8))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a, b = (folded(np.frombuffer(b"".join(side[i] for i in part), np.uint64).reshape(len(part), -1), words) for side in (left, right))
            out[part] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= limit[part]
    return out


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(row struct of all columns, text, h1, h2, n, sketch): a 128-bit hash of each text's set, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, width)
                sums = [(mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64), np.uint64(len(s))) for s in sets]
                cells = np.array(sums, np.uint64).reshape(-1, 3)
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(signed(np.ascontiguousarray(cells[:, i]))) for i in range(3)), pa.array([sketch(s) for s in sets], pa.binary())], ["row", "text", "h1", "h2", "n", "sketch"])

    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(rest, F.col("text").cast("string").alias("text"))
    empty = F.lit(None).cast("long")
    return rows.mapInArrow(tidied(run), rows.select("row", "text", empty.alias("h1"), empty.alias("h2"), empty.alias("n"), F.lit(None).cast("binary").alias("sketch")).schema)


def frequency_levels(nodes: DataFrame, width: int) -> np.ndarray:
    """log2 of a shingle's frequency, in the slot of its low bits (0: rare or not noticed)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(signed(values[often])), pa.array(n[often])], ["key", "n"])

        size = 0
        for batch in batches:
            for own in each(batch.column(0), width):
                held.append(own)
                size += len(own)
                if size > COUNTED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    level = F.floor(F.log2("n")).cast("int")
    slots = nodes.select("text").mapInArrow(tidied(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).groupBy(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.max(level).alias("level"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<u4").tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype(np.uint8).tobytes()], pa.binary())], ["slots", "levels"])

    table = np.zeros(SLOTS, np.uint8)
    # five bytes a slot at most; each partition is a job
    for r in slots.coalesce(FETCHES).mapInArrow(tidied(pack), "slots binary, levels binary").toLocalIterator():
        table[np.frombuffer(r.slots, "<u4")] = np.frombuffer(r.levels, np.uint8)
    return table


def postings(nodes: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, member): every node under each of its keys; a member is the node's id below the rank of its shingles' mean
    level, so that the smallest member of a list is its centre."""

    def scan_cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cost = [], []
            for own in each(batch.column(0), width):
                level = table[own & np.uint64(SLOTS - 1)]
                n.append(len(own))
                cost.append(float((2.0 ** np.sort(level)[: prefix_length(len(own), percent)]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(cost, pa.float64())], ["n", "cost"])

    short = nodes.where(F.col("n") <= LARGEST_LIGHT * 100 // percent)
    found = short.select("text").mapInArrow(tidied(scan_cost), "n long, cost double").groupBy("n").agg(F.count("*").alias("sets"), F.avg("cost").alias("cost")).collect()
    boundary = choose_boundary({r.n: r.sets for r in found}, {r.n: r.cost for r in found}, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, texts in text_chunks(batch.column(1)):
                keys, rank = [], []
                for own in shingle_sets(texts, width):
                    level = table[own & np.uint64(SLOTS - 1)]
                    keys.append(keys_of(own, level, boundary, percent))
                    rank.append(4095 - min(4095, int(128 * level.mean())) if len(own) else 4095)
                member = ids[a : a + len(texts)] | (np.array(rank, np.int64) << NODE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.repeat(member, [len(k) for k in keys]))], ["key", "member"])

    return nodes.select("node", "text").mapInArrow(tidied(run), "key long, member long")


def node_of(member: str) -> Column:
    return F.col(member).bitwiseAND(F.lit((1 << NODE_BITS) - 1))


def close(a: str, b: str, percent: int):
    """Sizes that can link."""
    return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)


def verify(pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (centre, node) that link: by their sketches, then by their whole sets."""
    side = lambda name, n, own: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("sketch").alias(own))
    known = pairs.join(side("node", "n", "own"), "node").join(side("centre", "centre_n", "centre_own"), "centre").where(close("n", "centre_n", percent))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            keep = pa.array(may_link(n, batch.column(3).to_pylist(), m, batch.column(5).to_pylist(), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["centre", "node"])

    return by_sets(save(known.select("centre", "node", "n", "own", "centre_n", "centre_own").mapInArrow(tidied(sift), "centre long, node long")), nodes, width, percent)


def by_sets(pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (centre, node; a written table, which goes) that link, by their whole sets."""
    named = pairs.select("node").unionAll(pairs.select("centre")).distinct()
    texts = save(nodes.select("node", "text").join(named, "node", "left_semi"))  # most texts are in no pair
    rows = pairs.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre").select("centre", "node", "centre_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (None, None)
        for whole in batches:
            for first, texts in text_chunks(whole.column(3)):
                batch = whole.slice(first, len(texts))
                centre, keep = batch.column(0).to_pylist(), []
                for i, own in enumerate(shingle_sets(texts, width)):
                    if known[0] != centre[i]:
                        known = centre[i], next(each(batch.column(2).slice(i, 1), width))
                    common = len(np.intersect1d(own, known[1], assume_unique=True))
                    keep.append(100 * common >= percent * (len(own) + len(known[1]) - common))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    out = save(rows.sortWithinPartitions("centre").mapInArrow(tidied(run), "a long, b long"))
    discard(pairs, texts)
    return out


def short_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(centre, node) pairs of short lists: members outside the list's largest component with all of other components."""
    x = members.where("not main").select("key", F.col("node").alias("centre"), F.col("n").alias("centre_n"), F.col("comp").alias("centre_comp"))
    pairs = x.join(members, "key").where(F.col("comp") != F.col("centre_comp")).where("main or centre < node").where(close("n", "centre_n", percent))
    return pairs.select(F.least("centre", "node").alias("centre"), F.greatest("centre", "node").alias("node")).distinct()


def long_pairs(lists: DataFrame, nodes: DataFrame, percent: int, every: bool) -> DataFrame:
    """(centre, node) pairs of long lists that sketches leave possible: outsiders with members of other components.

    ``lists`` is (key, node, comp, main).  Without ``every``, a part gives a spanning forest of the components that
    its pairs join.
    """
    size = lists.groupBy("key").agg(F.ceil(F.count_if(~F.col("main")) / OUTSIDE).alias("parts"), F.ceil(F.count("*") / MEMBERS).alias("chunks"))
    rows = lists.join(size, "key").join(nodes.select("node", "n", "sketch"), "node")
    turn = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    given = ["node", "comp", "n", "sketch"]
    outside = rows.where("not main").select("key", turn("parts").alias("part"), F.explode(upto("chunks")).alias("chunk"), F.lit(False).alias("member"), *given)
    members = rows.select("key", F.explode(upto("parts")).alias("part"), turn("chunks").alias("chunk"), F.lit(True).alias("member"), *given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], Forest()
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if now != tuple(at[a, :3].tolist()):
                    now, held, forest = tuple(at[a, :3].tolist()), [], Forest()
                part = by_length(batch.slice(a, b - a))
                if not at[a, 3]:
                    held += part
                    continue
                found: list[tuple[int, int]] = []
                for one in held:
                    for other in part:
                        if one[2].max() * 100 < percent * other[2].min() or other[2].max() * 100 < percent * one[2].min():
                            continue
                        for i, j in across(one, other, percent, every):
                            if every or forest.join(int(one[1][i]), int(other[1][j])):
                                found.append((int(one[0][i]), int(other[0][j])))
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["centre", "node"])

    dealt = outside.unionAll(members).repartition("key", "part", "chunk").sortWithinPartitions("key", "part", "chunk", "member")
    return dealt.mapInArrow(tidied(run), "centre long, node long").distinct()


def by_length(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, comp, n, sketches) of the rows whose sketches are of one length."""
    node, comp, n = (batch.column(i).to_numpy() for i in (4, 5, 6))
    own = batch.column(7).to_pylist()
    length = np.array([len(x) for x in own])
    out = []
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        out.append((node[at], comp[at], n[at], np.frombuffer(b"".join(own[i] for i in at), np.uint64).reshape(len(at), -1)))
    return out


def across(one: tuple, other: tuple, percent: int, every: bool) -> Iterator[tuple[int, int]]:
    """(i, j) of rows in different components whose sketches leave a link possible; without ``every`` one for each two
    components of a piece."""
    words = min(one[3].shape[1], other[3].shape[1])
    left, right = folded(one[3], words), folded(other[3], words)
    wide = max(1, WORDS // words)
    rows = max(1, min(len(left), int(wide**0.5)))
    for a in range(0, len(left), rows):
        for b in range(0, len(right), max(1, wide // rows)):
            x, y = slice(a, a + rows), slice(b, b + max(1, wide // rows))
            limit = allowed(one[2][x][:, None].astype(np.int64), other[2][y][None, :].astype(np.int64), percent)
            differ = np.bitwise_count(left[x][:, None, :] ^ right[y][None, :, :]).sum(2, dtype=np.int64)
            i, j = np.nonzero((differ <= limit) & (one[1][x][:, None] != other[1][y][None, :]))
            if not every and len(i):
                _, first = np.unique(np.stack([one[1][x][i], other[1][y][j]], 1), axis=0, return_index=True)
                i, j = i[first], j[first]
            yield from zip((i + a).tolist(), (j + b).tolist(), strict=True)


def label(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: the component of ``node`` under ``links``."""
    return rows.join(components(links), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, comp, main, size) of lists whose members, but for the centre, are in several components."""
    labelled = save(label(members.where("node <> centre"), links))
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("size"))
    several = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("size").alias("size"), F.max(F.struct("size", "comp")).alias("big")).where("comps > 1").select("key", "size", F.col("big.comp").alias("largest"))
    out = save(labelled.join(several, "key").withColumn("main", F.col("comp") == F.col("largest")).select("key", "node", "comp", "main", "size"))
    discard(labelled)
    return out


def cluster(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described documents, the nodes (different sets, each with its first document), and (node, root)."""
    described = describe(docs, width)
    doc_id = F.col("row.doc_id").cast("long")
    first = F.min_by(F.struct("row", "text", "sketch"), F.struct(doc_id.isNull(), doc_id, F.xxhash64("row", "text")))
    sets = described.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(doc_id).alias("first_id"), first.alias("first"))
    nodes = save(sets.select("h1", "h2", "n", "first_id", "first.row", "first.text", "first.sketch", F.monotonically_increasing_id().alias("node")))
    alone = nodes.select("node", F.col("node").alias("root"))
    if nodes.isEmpty():
        return described, nodes, alone
    posted = save(postings(nodes, frequency_levels(nodes, width), width, percent))
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("member").alias("centre")).where("size > 1").select("key", "centre")
    shared = posted.join(lists, "key").select("key", node_of("member").alias("node"), node_of("centre").alias("centre"))
    members = save(shared)
    discard(posted)
    links = verify(members.where("node <> centre").select("centre", "node").distinct(), nodes, width, percent)

    # every member has met its centre; what is left are pairs of other members in different components
    open_lists = open_members(members, links)
    discard(members)
    few = open_lists.where(F.col("size") <= SHORT).join(nodes.select("node", "n"), "node")
    if not open_lists.where(F.col("size") <= SHORT).isEmpty():
        links = links.unionAll(verify(short_pairs(few, percent), nodes, width, percent))
    long_lists = open_lists.where(F.col("size") > SHORT).select("key", "node")
    if not long_lists.isEmpty():
        for turn in range(FORESTS + 1):
            now = label(long_lists, links).select("key", "node", "comp")
            largest = now.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
            now = save(now.join(largest, "key").select("key", "node", "comp", (F.col("comp") == F.col("largest")).alias("main")))
            if now.isEmpty():
                break
            pairs = save(long_pairs(now, nodes, percent, every=turn == FORESTS))
            tried = pairs.count()
            more = by_sets(pairs, nodes, width, percent)
            links = links.unionAll(more)
            discard(now)
            if more.count() == tried:
                break  # every edge of the forests is a link, so what they join is one component
    return described, nodes, alone.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def join_components(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    described, nodes, roots = cluster(docs.select("doc_id", "text"), percent, width)
    named = nodes.select("node", "h1", "h2", "first_id").join(roots, "node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(smallest, "root").select("h1", "h2", "component_id")
    own = described.select(F.col("row.doc_id").cast("long").alias("doc_id"), "h1", "h2", "n")
    out = own.join(of_set, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """One document of each component: that of the smallest id (null ids last); texts without words all stay."""
    _, nodes, roots = cluster(docs, percent, width)
    age = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("node"))
    keep = nodes.select("node", "first_id").join(roots, "node").groupBy("root").agg(F.min_by("node", age).alias("node")).select("node")
    wordless = docs.where(~F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)))
    wordless = wordless.select(F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    kept = nodes.join(keep, "node", "left_semi").select("row", "text").unionAll(wordless.select("row", "text"))
    return kept.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
