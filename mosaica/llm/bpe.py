"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  Leaf ``i`` of the tree holds ``rank * width + i`` for the pair that begins
at symbol ``i`` (infinity if that pair has no merge), so the root is the leftmost pair of the lowest rank.
A merge changes three leaves, and each change climbs to the root: O(log n) a merge, until the root is
infinite.  Words are independent, so batches of short words of one width run through the same steps
together in NumPy; longer words take the scalar tree.

Edge cases: a null text is encoded as the empty one; an empty text has no ids, and decodes to the empty
text; a word of any length is one tree; repeated rows are encoded like any other.  Bytes that are not UTF-8
after decoding (only possible for ids that no text gives) become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import CACHES, chunks, text_chunks, tidied

#: Words of more bytes use the scalar tree.
BATCH_BYTES = 64
#: Words that one worker remembers; it starts anew when they are more.
CACHE_WORDS = 150_000
#: Above this code point the library's own splitter is asked, so that Unicode versions cannot differ.
KNOWN = 0xFF

_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_INF = np.int64(1) << 60


def char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(KNOWN + 1) if unicodedata.category(chr(c))[0] == kind)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Words and their ids; a look-up of an unknown word notes it and gives nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.unknown: dict = {}

    def __missing__(self, word) -> bytes:
        self.unknown[word] = None
        return b""

    def ids(self, words: list) -> bytes:
        return b"".join(map(self.__getitem__, words))


class Splitter:
    """The words of byte-level vocabularies: contractions, letters, digits, others, white space."""

    def __init__(self, library) -> None:
        letters, digits = char_class("L"), char_class("N")
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{_SPACE}{letters}{digits}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        self.unknown = re.compile(f"[^\x00-{chr(KNOWN)}]").search
        self.library, self.symbols = library, byte_symbols()

    def __call__(self, text: str) -> list[str]:
        """Words as text, or as bytes where the library had to split."""
        if not self.unknown(text):
            return self.find(text)
        return [bytes(self.symbols[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


class SegmentTreeBPE:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.base = np.full(256, -1, np.int64)
        for s, b in symbols.items():
            self.base[b] = vocab[s]
        self.shift = int(max([*vocab.values(), *self.special.values()])).bit_length()
        codes = np.array([(vocab[a] << self.shift) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = {int(c): r for r, c in enumerate(codes)}
        self.bytes = [b""] * (1 << self.shift)
        for s, i in vocab.items():
            self.bytes[i] = bytes(symbols[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.split = Splitter(Tokenizer.from_file(path))
        self.cache = Words()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << self.shift) | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def encode_batch(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > BATCH_BYTES:
                out[i] = self.encode_long(w)
            elif w:
                by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for k in range(0, len(rows), 4096):
                part = rows[k : k + 4096]
                for i, ids in zip(part, self._trees([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _trees(self, words: list[bytes], width: int) -> list[bytes]:
        """One segment tree a row; leaf i of a row is node ``width + i``, the root is node 1."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        here = np.arange(width)
        sym = np.where(here < size[:, None], self.base[raw], -1)
        after = np.where(here + 1 < size[:, None], here + 1, width)
        after = np.hstack([after, np.full((n, 1), width)])
        before = np.broadcast_to(here - 1, (n, width)).copy()
        sym = np.hstack([sym, np.full((n, 1), -1)])  # the column behind the last symbol
        before = np.hstack([before, np.zeros((n, 1), np.int64)])
        tree = np.full((n, 2 * width), _INF, np.int64)
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        tree[:, width:] = np.where(rank >= 0, rank * width + here, _INF)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _INF)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            sym[live, i] = self.merged[root // width]
            k = after[live, j]
            after[live, i] = k
            before[live, k] = i
            sym[live, j] = -1
            p = before[live, i]
            self._set(tree, width, live, j, np.full(len(live), -1))
            self._set(tree, width, live, i, self._rank(sym[live, i], np.where(k < width, sym[live, k], -1)))
            had = p >= 0
            rows, p = live[had], p[had]
            self._set(tree, width, rows, p, self._rank(sym[rows, p], sym[rows, i[had]]))
            live = live[tree[live, 1] < _INF]
        sym = sym[:, :-1]
        keep = sym >= 0
        flat, ends = sym[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [flat[b:e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
        """A point update in each row's tree, carried to the root."""
        node = leaf + width
        tree[rows, node] = np.where(rank >= 0, rank * width + leaf, _INF)
        node = node >> 1
        while width > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node, width = node >> 1, width >> 1

    def encode_long(self, word: bytes) -> bytes:
        """The same tree for one word of any length."""
        n, none, shift, pairs = len(word), 1 << 60, self.shift, self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        sym = self.base[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get((sym[i] << shift) | sym[i + 1])) is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        def pair(i: int) -> int:
            r = pairs.get((sym[i] << shift) | sym[after[i]]) if after[i] < n else None
            return none if r is None else r * width + i

        merged = self.merged
        while (root := tree[1]) < none:
            i, j = root % width, after[root % width]
            sym[i], sym[j] = int(merged[root // width]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for begin, end in chunks(texts):
            cache, out, later = self.cache, [], []
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for text in texts[begin:end]:
                words = self._words(text or "")
                before = len(cache.unknown)
                out.append(cache.ids(words))
                if len(cache.unknown) > before or (before and any(w in cache.unknown for w in words)):
                    later.append((len(out) - 1, words))
            new = list(cache.unknown)
            cache.unknown.clear()
            cache.update(zip(new, self.encode_batch([w if isinstance(w, bytes) else w.encode() for w in new]), strict=True))
            for i, words in later:
                out[i] = cache.ids(words)
            yield from out

    def _words(self, text: str) -> list:
        if not any(s in text for s in self.special):
            return self.split(text)
        words: list = []
        for piece in self.find_special(text):
            if piece in self.special:
                self.cache[piece, 0] = np.array([self.special[piece]], "<u4").tobytes()
                words.append((piece, 0))
            elif piece:
                words += self.split(piece)
        return words

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, SegmentTreeBPE] = {}
CACHES["bpe"] = _LOADED.clear


def load(path: str) -> SegmentTreeBPE:
    """One encoder a worker process: the word cache outlives tasks."""
    if path not in _LOADED:
        _LOADED[path] = SegmentTreeBPE(path)
    return _LOADED[path]


def encode_column(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without ``text`` but with ``ids array<int>``; no shuffle.

    Other columns pass through unchanged, so clashing names are those of ``docs`` alone; an existing
    column ``ids`` is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*kept, F.array(F.lit(1)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            parts = list(bpe.encode(texts))
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*kept, ids])

    return docs.select(F.col(text), *kept).mapInArrow(tidied(run, "bpe"), schema)


def decode_column(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` without ``ids`` but with the decoded ``text``; null ids decode to null."""
    kept = [c for c in tokens.columns if c not in (text, ids)]
    schema = tokens.select(*kept, F.lit("").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            out = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*kept, text])

    return tokens.select(F.col(ids), *kept).mapInArrow(tidied(run, "bpe"), schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids are decoded again.

    One narrow pass over whole texts; ids never leave the worker, which is what makes this cheaper than
    ``encode_column`` followed by ``decode_column``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            n, a, b = [], [], []
            for _, texts in text_chunks(batch.column(1)):
                for ids in bpe.encode(texts):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
