"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are dealt to files by ranges of ``doc_id`` and written in ascending order, so that a file's
stripes can be read in parallel and a look-up of ids reads the metadata first: file and stripe ranges,
row-index entries and Bloom filters prune what cannot hold them.  A file knows its place among the files
(``part``) and the ids before each document inside it (``part_start``); ids before a file are a sum over one
row a file.

Schema of a file: doc_id long, part int, part_start long, n_tokens int, ids array<int>.

Edge cases: a null text has the end id alone, like an empty one; documents without ``doc_id`` come first;
repeated ids are ordered by a hash of their text; an empty table gives no file rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaica.llm.common import CACHES, chunks, partitions, text_chunks, tidied

SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
#: Characters whose words are told apart at once.
PIECE = 2_400_000
#: Words that one worker remembers: when half as many are new, those that were not met since the last time go.
CACHE_WORDS = 250_000


class CachedEncoder:
    """The tokenizers library behind a table of words.

    Vocabularies with word ends drop white space and encode each pre-split word on its own.  Texts of Latin-1
    characters, where all Unicode versions agree, are put in lower case and split here, many at once: bytes of one
    class are a word (a digit is one of its own), each different word of a piece is looked up once (an Arrow dictionary
    tells them apart), and unknown words go to the library many at a time, told apart in its answer by their ends.  Any other text (other characters, an apostrophe that may begin a contraction,
    control characters, a special token) goes to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.hard = re.compile("[^\x00-\xff]|[\x1c-\x1f]|'[sStTrRvVmMlLdD]" + (f"|{special}" if special else "")).search
        #: what any hard text of Latin-1 characters has one of
        self.signs = sorted({*"\x1c\x1d\x1e\x1f'", *(t.content[0] for t in self.library.get_added_tokens_decoder().values() if t.content)})
        characters = [chr(c) for c in range(256)]
        self.kind = bytes(0 if c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3) for c in characters)
        self.lower = bytes(ord(c.lower()) for c in characters)
        # words are normalised and split already: the library's model alone is enough if it sees each character as one or more of its own
        self.written = {c: self._seen(chr(c)) for c in range(256) if self.kind[c]}
        letters = [c for c in self.written if self.kind[c] == 1 and self.lower[c] == c]
        self.model = None
        if all(self.written.values()) and self._seen("".join(map(chr, letters))) == "".join(self.written[c] for c in letters):
            self.model = Tokenizer.from_file(path)
            self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
            self.model.no_truncation()
            self.model.no_padding()
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _seen(self, word: str) -> str:
        """What the model sees of a word; nothing if that is not one piece."""
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        word = normal.normalize_str(word) if normal else word
        pieces = [p for p, _ in split.pre_tokenize_str(word)] if split else [word]
        return pieces[0] if len(pieces) == 1 and not any(map(str.isspace, pieces[0])) else ""

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: many are one text, each of whose words has one token that ends it."""
        out: list[bytes] = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            text = " ".join(part)
            seen = self.model.encode_batch_fast([text.translate(self.written)], add_special_tokens=False) if self.model else self.library.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(seen[0].ids, "<u4")
            last = np.flatnonzero(self.last[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * last).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self._whole(part)
        return out

    def _easy(self, text: str) -> bytes | None:
        """The bytes of a text that is split here."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(c in text for c in self.signs) and self.hard(text) else raw

    def _split(self, raw: list[bytes]) -> list[bytes]:
        lower = b"\n".join([*raw, b""]).translate(self.lower)
        data, kind = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(self.kind), np.uint8)
        inside, opens = kind > 0, kind == 2
        opens[:1] = True
        opens[1:] |= kind[1:] != kind[:-1]
        opens = opens[inside]
        offsets = np.append(np.flatnonzero(opens), len(opens)).astype(np.int32)  # the words' bytes alone, one behind the other
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        if 2 * len(self.table) > CACHE_WORDS:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        keys = words.dictionary.to_pylist()
        parts = [*map(table.get, keys)]
        missing = [i for i, p in enumerate(parts) if p is None]
        for i in missing:
            parts[i] = older.get(keys[i])
        new = [i for i in missing if parts[i] is None]
        for i, found in zip(new, self._words([keys[i].decode("latin-1") for i in new]), strict=True):
            parts[i] = found
        table.update((keys[i], parts[i]) for i in missing)
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        word = words.indices.to_numpy()
        n = size[word]
        behind = np.cumsum(n)
        out = ids[np.repeat(start[word] - (behind - n), n) + np.arange(int(n.sum()))].tobytes()
        base = np.cumsum([0, *(len(r) + 1 for r in raw)]).tolist()
        inner = np.cumsum([0, *(np.count_nonzero(inside[a:b]) for a, b in zip(base[:-1], base[1:], strict=True))])  # bytes of words before each text
        edge = np.concatenate([[0], 4 * behind])[np.searchsorted(offsets[:-1], inner)].tolist()
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for begin, end in chunks(texts, PIECE):
            part = [t or "" for t in texts[begin:end]]
            raw = [self._easy(t) for t in part]
            hard = [i for i, r in enumerate(raw) if r is None]
            easy = sorted(set(range(len(part))) - set(hard))
            out = dict(zip(easy, self._split([raw[i] for i in easy]), strict=True)) | dict(zip(hard, self._whole([part[i] for i in hard]), strict=True))
            yield from (out[i] for i in range(len(part)))


_LOADED: dict[str, CachedEncoder] = {}
CACHES["token_files"] = _LOADED.clear


def load(path: str) -> CachedEncoder:
    if path not in _LOADED:
        _LOADED[path] = CachedEncoder(path)
    return _LOADED[path]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str, files: int | None = None, stripe_mb: int = 16, index_rows: int = 1000) -> None:
    """Encodes every whole text and writes the ORC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start, end = load(vocabulary), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in text_chunks(batch.column(1), PIECE):
                parts = [ids + end for ids in encoder.encode(texts)]
                n = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(n.astype(np.int32)), ids], ["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(offsets[-1])

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (ordered.mapInArrow(tidied(run, "token_files"), SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows)).option("orc.stripe.size", str(stripe_mb << 20)).option("compression", "zstd").orc(path))
    # the manifest: what a look-up has to know before it opens any file (Spark's readers pass over names that begin with _)
    rows = spark.read.schema(SCHEMA).orc(path).select("doc_id", "part", F.col("part_start"), "n_tokens", F.input_file_name().alias("file"))
    files_of = rows.groupBy("part", "file").agg(F.count("*").alias("rows"), F.max(F.col("part_start") + F.col("n_tokens")).alias("total"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("doc_id").isNull()).alias("null_ids"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files_of.withColumn("before", before).drop("total").coalesce(1).write.parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: part, file, rows, first_id, last_id, null_ids, and ``before``, the ids in the files before it."""
    return spark.read.schema("part int, file string, rows long, first_id long, last_id long, null_ids long, before long").parquet(f"{path}/_manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents with ``start``: all ids before a document, over all files.

    A filter on ``doc_id`` reaches the files' metadata.  ``start`` comes from the manifest, a row a file, broadcast.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return started(rows, manifest(spark, path))


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``read_tokens`` of some ids: only the files whose range holds one of them are opened."""
    wanted = sorted(set(doc_ids))
    files = manifest(spark, path)
    ranges = F.exists(F.array(*map(F.lit, wanted)), lambda i: i.between(F.col("first_id"), F.col("last_id"))) if wanted else F.lit(False)
    held = [r.file for r in files.where(ranges).select("file").collect()]  # at most a file or two an id
    if not held:
        return read_tokens(spark, path).limit(0)
    return started(spark.read.schema(SCHEMA).orc(held).where(F.col("doc_id").isin(wanted)), files)


def started(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(files.select("part", "before")), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def crc_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_tokens``; counts come from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(tidied(run, "token_files"), "doc_id long, start long, n_tokens long, ids_crc32 long")
