"""Nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional word from each of several codebooks.  The words of the first,
coarse, book name the lists of the index; one for each ``IN_LIST`` vectors up to ``LISTS``.  The others hold 256
words each and are trained on what is left: k-means on residuals, then one least-squares refit of all their words to
beam-search codes.  Training uses a sample (documented bound ``sample``), the vectors of the smallest hashes.  Every
vector is indexed: a beam search over all books picks its words, and its norm and that of its reconstruction are
stored.  A query's table of inner products with all words gives an estimate for each code by look-ups, scaled by the
stored norms; the ``rerank`` best of each list (of each block, where a list is long) are scored exactly in double
precision.  With each code goes a bound of its error, so that a row whose estimate and bound reach the last of these is
scored exactly too: of the lists that are probed, nothing is missed, however close its rows lie.

A query probes the lists whose coarse words have the largest inner products with it.  How many, is measured: for
``CALIBRATION`` queries the exact neighbours are found among all vectors in one pass, and the number of probes is the
least that reaches ``recall`` of them.  Vectors in clusters need a few lists of many; directions drawn evenly in many
dimensions (no structure to prune by) need a share of them all.

Lists longer than ``BLOCK`` are dealt into blocks by a hash of the vector, and the queries of a list that many ask
into parts, so no key is large, and the answer does not depend on partitions.  One shuffle brings blocks and queries
together, sorted so that a block comes before its queries: a task holds one block and one batch of queries.

Equal vectors are coded once with their smallest ids, of which no query can need more than ``k`` + 1; equal
queries are searched once.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without id; a repeated id is one row for each different vector; ties go to the smaller id; fewer
candidates than ``k`` are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import discard, save, tidied

#: Vectors of a list, and queries of a list, that one task holds together.
BLOCK = 8192
QUERIES = 65536
#: Vectors of a list on average, until there are as many lists as ``LISTS``.
IN_LIST = 1024
LISTS = 4096
#: Queries whose exact neighbours say how many lists are probed.
CALIBRATION = 256
#: Queries that are scored at once.
STEP = 64
RESULT = "query_id long, rank int, vec_id long, score double"
ROW = "key long, query boolean, id long, v binary, ids array<long>, code binary"


@dataclass
class Codebooks:
    coarse: np.ndarray  # lists, dimensions
    words: np.ndarray  # books, words, dimensions

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) by a beam search: at each book, the best continuations of all kept prefixes go on."""
        lists, out = np.zeros(len(x), np.int64), np.zeros((len(x), len(self.words)), np.uint8)
        for a in range(0, len(x), 1024):
            left = x[a : a + 1024][:, None, :].astype(np.float32)
            codes = np.zeros((len(left), 1, 0), np.int32)
            for book in (self.coarse, *self.words):
                k, dims = book.shape
                error = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dims) @ book.T).reshape(len(left), -1, k) + (book * book).sum(1)
                flat = error.reshape(len(left), -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (len(left), keep))
                parent, word = best // k, best % k
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
                left = np.take_along_axis(left, parent[:, :, None], 1) - book[word]
            final = codes[np.arange(len(left)), (left * left).sum(2).argmin(1)]
            lists[a : a + 1024], out[a : a + 1024] = final[:, 0], final[:, 1:]
        return lists, out

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[lists]
        for m, book in enumerate(self.words):
            out = out + book[codes[:, m]]
        return out


def sums(near: np.ndarray, x: np.ndarray, words: int) -> np.ndarray:
    """Sum of the rows of ``x`` that go to each word."""
    out = np.zeros((words, x.shape[1]), np.float32)
    np.add.at(out, near, x)
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words * words).sum(1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ words.T).argmin(1) for a in range(0, len(x), 4096)])


def k_means(x: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), words, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=words)
        c[n > 0] = sums(near, x, words)[n > 0] / n[n > 0, None]
    return c


def train(x: np.ndarray, lists: int, books: int, words: int, rounds: int = 6, seed: int = 10) -> Codebooks:
    rng, x, made = np.random.default_rng(seed), x.astype(np.float32), []
    coarse = k_means(x, min(lists, len(x)), rounds, rng)
    left, words = x - coarse[nearest(x, coarse)], min(words, len(x))
    for _ in range(books):
        c = k_means(left, words, rounds, rng)
        left = left - c[nearest(left, c)]
        made.append(c)
    first = Codebooks(coarse, np.stack(made))
    at, codes = first.encode(x)  # now refit all words at once to beam-search codes
    codes, rest = codes.astype(np.int64), x - coarse[at]
    gram, right = np.zeros((books, words, books, words), np.float32), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        right[m] = sums(codes[:, m], rest, words)
        for n in range(m, books):
            both = np.bincount(codes[:, m] * words + codes[:, n], minlength=words * words).reshape(words, words)
            gram[m, :, n], gram[n, :, m] = both, both.T
    gram, right, start = gram.reshape(books * words, -1), right.reshape(books * words, -1), first.words.reshape(books * words, -1)
    right = right - gram @ start
    gram[np.diag_indices(len(gram))] += 0.1
    second = Codebooks(coarse, (start + np.linalg.solve(gram, right)).reshape(first.words.shape).astype(np.float32))
    errors = ((x - first.decode(at, codes)) ** 2).sum(), ((x - second.decode(*second.encode(x))) ** 2).sum()
    return second if errors[1] < errors[0] else first


def usable(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<float or double>) of the rows that take part, and the number of dimensions."""
    v = F.col(vector)
    fine = v.isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    most = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims = most.d if most else 0
    return good.where(F.size("v") == dims), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def stacked(column: pa.Array, kind: str) -> np.ndarray:
    """Binary cells of one length as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0), kind)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), -1)


def distinct_vectors(good: DataFrame, dims: int, most: int) -> DataFrame:
    """(v binary, ids) of every different vector; ids are its ``most`` smallest, gathered inside batches first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            own: dict[bytes, list[int]] = {}
            for i, row in zip(ids.tolist(), raw + 0.0, strict=True):  # + 0.0: one zero
                own.setdefault(row.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([sorted(set(v))[:most] for v in own.values()], pa.list_(pa.int64()))], ["v", "ids"])

    part = good.mapInArrow(tidied(gather), "v binary, ids array<long>")
    return part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def facts(x: np.ndarray, made: Codebooks, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(norm, norm of the reconstruction, bound) of each row: an estimate by look-ups is off by no more than the bound times the query's norm."""
    back = made.decode(lists, codes)
    norms = np.stack([np.linalg.norm(x, axis=1), np.linalg.norm(back.astype(np.float64), axis=1)], 1).astype("<f4")
    scale = (norms[:, 0] / np.maximum(norms[:, 1], 1e-12)).astype(np.float64)
    size = np.linalg.norm(made.coarse.astype(np.float64), axis=1)[lists] + sum(np.linalg.norm(b.astype(np.float64), axis=1)[codes[:, m]] for m, b in enumerate(made.words))
    rounded = (x.shape[1] + 2 * len(made.words) + 8) * 2.0**-23 * scale * size  # by sums in single precision
    off = np.linalg.norm(x - scale[:, None] * back, axis=1)
    return np.concatenate([norms, ((off + rounded) * (1 + 1e-6)).astype("<f4")[:, None]], 1)


def encoded(distinct: DataFrame, made: Codebooks) -> DataFrame:
    """(list, h, v, ids, code): ``code`` holds both norms, the bound of the error and the words of the residual books."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(batch.column(0), "<f8")
            lists, codes = made.encode(x)
            raw = np.concatenate([facts(x, made, lists, codes).view(np.uint8).reshape(len(x), 12), codes], 1)
            yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column(2), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], ["list", "h", "v", "ids", "code"])

    return distinct.select("v", "ids", F.xxhash64("v").alias("h")).mapInArrow(tidied(run), "list long, h long, v binary, ids array<long>, code binary")


def order_of_lists(query: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Lists by falling inner product of their words with each query; ties to the smaller list."""
    return np.argsort(-(query.astype(np.float32) @ coarse.T), axis=1, kind="stable")


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, in order; ties by id."""
    at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if k < len(score) else np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def probes_for(index: DataFrame, sample: np.ndarray, coarse: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold ``recall`` of the exact neighbours of the sampled queries."""
    n = len(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, x, ids = batch.column(0).to_numpy(), stacked(batch.column(1), "<f8"), batch.column(2).to_numpy()
            for a in range(0, len(x), 4096):
                scores, own, where = sample @ x[a : a + 4096].T, ids[a : a + 4096], lists[a : a + 4096]
                for q in range(n):
                    new = first_of(scores[q], own, k + 1)
                    score, other, at = (np.concatenate(pair) for pair in zip(held[q], (scores[q, new], own[new], where[new]), strict=True))
                    keep = first_of(score, other, k + 1)
                    held[q] = score[keep], other[keep], at[keep]
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), [len(h[0]) for h in held])), *map(pa.array, columns)], ["q", "score", "id", "list"])

    per = index.select("list", "v", F.col("ids")[0]).mapInArrow(tidied(run), "q long, score double, id long, list long")
    best = per.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "list"))), 1, k + 1).alias("best")).collect()
    place = np.argsort(order_of_lists(sample, coarse), axis=1)  # the turn in which a list is probed
    turns = np.sort(np.array([place[r.q, b["list"]] for r in best for b in r.best], np.int64))
    return int(turns[max(0, int(np.ceil(recall * len(turns))) - 1)]) + 1 if len(turns) else 1


def exact_best(query: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` best rows for each query; equal scores: the smaller place first.

    A matrix product picks candidates; where its rounding could hide one, all rows are scored singly.
    """
    k = min(k, len(vectors))
    rough, keep = query @ vectors.T, min(k + 12, len(vectors))
    top = np.argpartition(-rough, keep - 1, axis=1)[:, :keep] if keep < len(vectors) else np.broadcast_to(np.arange(keep), (len(query), keep))
    top = np.sort(top, axis=1)
    exact = np.einsum("qrd,qd->qr", vectors[top], query)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    place, score = np.take_along_axis(top, order, 1), np.take_along_axis(exact, order, 1)
    if keep < len(vectors):
        slack = 1e-13 * np.sqrt((query * query).sum(1) * (vectors * vectors).sum(1).max())
        for q in np.flatnonzero(~(score[:, -1] - np.take_along_axis(rough, top, 1).min(1) > slack)):
            every = np.einsum("qrd,qd->qr", vectors[None], query[q : q + 1])[0]
            place[q] = np.argsort(-every, kind="stable")[:k]
            score[q] = every[place[q]]
    return place, score


def best(query: np.ndarray, block: tuple, made: Codebooks, at: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of each query, vec_ids, scores): the ``k`` best of a block, whose rows are in the order of their ids."""
    vectors, ids, counts, norm, back, bound, codes = block
    keep = max(rerank, k)
    if keep < len(codes):
        low = query.astype(np.float32)
        estimate = np.repeat((low @ made.coarse[at])[:, None], len(codes), 1)
        for m, book in enumerate(made.words):
            estimate += (low @ book.T).take(codes[:, m], axis=1)
        estimate *= norm / np.maximum(back, 1e-12)
        some = np.argpartition(-estimate, keep - 1, axis=1)[:, :keep]
        last = -np.partition(-np.einsum("qrd,qd->qr", vectors[some], query), k - 1, axis=1)[:, k - 1]
        reach = np.linalg.norm(query, axis=1)[:, None] * bound + estimate
        open_rows = ~(reach < last[:, None]).all(0)  # whatever an estimate cannot rule out
        open_rows[some.ravel()] = True
        rows = np.flatnonzero(open_rows)
        top, exact = exact_best(query, vectors[rows] if len(rows) < len(vectors) else vectors, k)
        top = rows[top]
    else:
        top, exact = exact_best(query, vectors, k)
    first = np.cumsum(counts) - counts
    if (counts[top] == 1).all():
        return np.full(len(query), top.shape[1]), ids[first[top]].ravel(), exact.ravel()
    size, found, scores = [], [], []
    for q in range(len(query)):  # vectors with several ids
        rows = np.repeat(np.arange(top.shape[1]), counts[top[q]])
        every = np.concatenate([ids[first[p] : first[p] + counts[p]] for p in top[q]])
        order = np.lexsort((every, -exact[q][rows]))[:k]
        size.append(len(order))
        found.append(every[order])
        scores.append(exact[q][rows[order]])
    return np.array(size), np.concatenate(found), np.concatenate(scores)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", books: int = 15, words: int = 256, sample: int = 32_768, rerank: int = 64, recall: float = 0.99) -> DataFrame:
    """The ``k`` rows found nearest to each of ``queries`` (rows of the same table) by inner product."""
    spark = rows.sparkSession
    good, dims = usable(rows, vec_id, vector)
    asked, asked_dims = usable(queries, vec_id, vector)
    if not dims or asked_dims != dims:
        return spark.createDataFrame([], RESULT)
    distinct = save(distinct_vectors(good, dims, k + 1))
    lists = min(LISTS, max(1, distinct.count() // IN_LIST))
    drawn = distinct.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(min(sample, max(8192, 16 * lists))).select("v").collect()
    made = train(np.frombuffer(b"".join(bytes(r.v) for r in drawn), np.float64).reshape(-1, dims), lists, books, words)
    index = save(encoded(distinct, made))
    discard(distinct)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [r.tobytes() for r in matrix(batch.column(1), dims) + 0.0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["query_id", "v"])

    wanted = save(asked.mapInArrow(tidied(keyed), "query_id long, v binary").distinct())
    asks = save(wanted.select("v").distinct().withColumn("id", F.monotonically_increasing_id()))
    few = asks.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(CALIBRATION).select("v").collect()
    probes = probes_for(index, np.frombuffer(b"".join(bytes(r.v) for r in few), np.float64).reshape(-1, dims), made.coarse, k, recall)

    total = len(made.coarse)
    length = {r.list: r.n for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a number for each list
    blocks = np.array([-(-length.get(i, 0) // BLOCK) for i in range(total)], np.int64)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = order_of_lists(stacked(batch.column(0), "<f8"), made.coarse)[:, :probes]
                n = np.bincount(hit.ravel(), minlength=total)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["list", "n"])

    popular = {r.list: r.n for r in asks.select("v").mapInArrow(tidied(turns), "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}
    parts = np.array([max(1, -(-popular.get(i, 0) // QUERIES)) for i in range(total)], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks * parts)])  # keys of list i: first[i] + block * parts[i] + part

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's row for each part of its list's queries (one, but for lists that very many queries ask)."""
        for batch in batches:
            at = batch.column(0).to_numpy()
            block = batch.column(1).to_numpy() % np.maximum(blocks[at], 1)
            row = np.repeat(np.arange(len(at)), parts[at])
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
            key = first[at[row]] + block[row] * parts[at[row]] + part
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(row), bool)), pa.array(at[row]), batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take)], ["key", "query", "id", "v", "ids", "code"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's row for each block of the lists that it probes."""
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                hit = order_of_lists(stacked(batch.column(1), "<f8"), made.coarse)[:, :probes]
                ids, at = np.repeat(batch.column(0).to_numpy(), hit.shape[1]), hit.ravel()
                row = np.repeat(np.arange(len(at)), blocks[at])
                block = np.arange(len(row)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
                key = first[at[row]] + block * parts[at[row]] + ids[row] % parts[at[row]]
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(n, bool)), pa.array(ids[row]), batch.column(1).take(pa.array(row // hit.shape[1] if n == len(at) else np.repeat(np.arange(batch.num_rows), hit.shape[1])[row])), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], ["key", "query", "id", "v", "ids", "code"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, each followed by its queries."""
        now, waiting, block, at = None, [], None, 0
        for batch in batches:
            keys, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(query.view(np.int8)) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != now:
                    now, waiting, block = keys[a], [], None
                if not query[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if block is None:
                    if not waiting:
                        continue
                    held = pa.Table.from_batches(waiting)
                    held = held.take(np.argsort(pc.list_element(held["ids"], 0).to_numpy(), kind="stable")).combine_chunks()
                    code = stacked(held["code"], np.uint8)
                    norms = np.ascontiguousarray(code[:, :12]).view("<f4")
                    lists = held["ids"].combine_chunks()
                    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    block = stacked(held["v"], "<f8"), lists.flatten().to_numpy(), counts, *norms.T, code[:, 12:]
                    at, waiting = int(held["id"][0].as_py()), []
                for c in range(a, b, STEP):
                    part = batch.slice(c, min(STEP, b - c))
                    size, found, scores = best(stacked(part.column(3), "<f8"), block, made, at, k + 1, rerank)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                    entries = pa.StructArray.from_arrays([pa.array(-scores), pa.array(found)], ["negative", "vec_id"])
                    yield pa.RecordBatch.from_arrays([part.column(2), pa.ListArray.from_arrays(offsets, entries)], ["id", "best"])

    both = index.select("list", "h", "v", "ids", "code").mapInArrow(tidied(place), ROW).unionAll(asks.select("id", "v").mapInArrow(tidied(route), ROW))
    dealt = both.repartition(F.col("key")).sortWithinPartitions("key", "query")
    found = dealt.mapInArrow(tidied(scan), "id long, best array<struct<negative:double,vec_id:long>>")
    top = save(found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best")))
    discard(index)
    answers = wanted.join(asks, "v").join(top, "id").select("query_id", F.expr(f"slice(filter(best, x -> x.vec_id <> query_id), 1, {int(k)})").alias("best"))
    # an id of several vectors asks with each: its best of all
    per_id = answers.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))
    return per_id.select("query_id", F.posexplode("best").alias("place", "at")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("at.vec_id").alias("vec_id"), (-F.col("at.negative")).alias("score"))
