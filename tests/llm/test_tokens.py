import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mosaica.llm import bpe, token_files
from mosaica.llm.common import scratch_dir, table
from mosaica.llm.queries import BYTE_BPE, END_ID, WORD_BPE

ODD = ["", None, "a<|endoftext|>b  <|endoftext|>", "<|startoftext|> x", "日本語 テスト 😀 don't  \n\n  x", "  lead\t\x1c\x85 a\xa0b", "a" * 3000 + " " + "xyz" * 500, "I'M it's ½ ²3 ª", "İstanbul ΑΣ ς é", " " * 70 + "x", "\n" * 200, "same", "same"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def rows(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    return [*enumerate(ODD), *((100 + i, t) for i, t in enumerate(texts)), (None, "no id"), (7, "an id twice")]


def test_segment_tree_equals_library(make_docs, rows):
    path, lib = public_tokenizers.path(BYTE_BPE), library(BYTE_BPE)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(make_docs(rows), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_columns_round_trip(make_docs):
    path = public_tokenizers.path(BYTE_BPE)
    docs = make_docs([*enumerate(ODD)]).withColumnRenamed("source", "ids")  # a clashing name is replaced
    tokens = bpe.encode_column(docs, path)
    assert tokens.columns == ["doc_id", "lang", "n_chars", "ids"]
    back = {r.doc_id: r.text for r in bpe.decode_column(tokens, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 65, 500])
def test_both_trees_agree(size):
    rng, enc = np.random.default_rng(size), bpe.SegmentTreeBPE(public_tokenizers.path(BYTE_BPE))
    words = [bytes(rng.choice(list(b"etaoinshr "), size).tolist()) for _ in range(20)]
    assert [enc.encode_long(w) for w in words] == enc.encode_batch(words)


def test_token_files(spark, make_docs, rows):
    lib, path = library(WORD_BPE), scratch_dir(spark)
    token_files.write_tokens(make_docs(rows), public_tokenizers.path(WORD_BPE), END_ID, path, files=3)
    got = token_files.crc_rows(token_files.read_tokens(spark, path)).collect()
    key = {}
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4")
        key.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in key[r.doc_id]
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    plan = token_files.read_tokens(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan.replace(" ", "")


def test_empty_table(spark, make_docs):
    path = scratch_dir(spark)
    token_files.write_tokens(make_docs([]), public_tokenizers.path(WORD_BPE), END_ID, path)
    assert token_files.crc_rows(token_files.read_tokens(spark, path)).count() == 0
    assert bpe.round_trip(make_docs([]), public_tokenizers.path(BYTE_BPE)).count() == 0


def test_metadata_of_files(spark, make_docs, tmp_path):
    """Stripes, row indexes and Bloom filters are in the files; a look-up opens one file."""
    path = scratch_dir(spark)
    docs = [(i, f"word {i} " + "text of some length " * 60) for i in range(0, 60000, 3)]
    token_files.write_tokens(make_docs(docs), public_tokenizers.path(WORD_BPE), END_ID, path, files=3, stripe_mb=0, index_rows=1000)
    files = sorted(token_files.manifest(spark, path).collect(), key=lambda r: r.part)
    assert len(files) == 3 and sum(r.rows for r in files) == len(docs)
    assert [r.before for r in files] == sorted({r.before for r in files}) and files[0].before == 0
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0].file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() > 1
    every = gateway.new_array(jvm.boolean, 7)
    for i in range(7):
        every[i] = True
    index = reader.rows().readRowIndex(0, every, every)
    blooms = index.getBloomFilterIndex()
    assert blooms[1] is not None and blooms[1].getBloomFilterCount() >= 1 and blooms[2] is None
    import pyarrow.orc

    whole = pyarrow.orc.ORCFile(files[0].file.removeprefix("file://"))
    stripes = [whole.read_stripe(i, ["doc_id"]).num_rows for i in range(whole.nstripes)]  # each on its own
    assert sum(stripes) == files[0].rows
    found = token_files.look_up(spark, path, [3, 30, 31])
    assert len(found.inputFiles()) >= 1 and sum(f.endswith(".orc") for f in found.inputFiles()) == 1
    want = {r.doc_id: r.start for r in token_files.read_tokens(spark, path).collect()}
    assert {r.doc_id: r.start for r in found.collect()} == {i: want[i] for i in (3, 30)}
    assert token_files.look_up(spark, path, []).count() == token_files.look_up(spark, path, [10**9]).count() == 0


def test_very_long_text(spark, make_docs):
    lib, path = library(WORD_BPE), scratch_dir(spark)
    text = "".join(f"Word{i % 977} isn't, {i} " for i in range(150_000))  # some MB
    token_files.write_tokens(make_docs([(1, text), (2, "x" * 200_000)]), public_tokenizers.path(WORD_BPE), END_ID, path)
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert got[1] == [*lib.encode(text, add_special_tokens=False).ids, END_ID]
    assert got[2] == [*lib.encode("x" * 200_000, add_special_tokens=False).ids, END_ID]


def test_frequent_words_are_encoded_once(monkeypatch):
    """A full table lets rare words go, not those that come back; ids are the library's."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 400)
    encoder, sent = token_files.CachedEncoder(public_tokenizers.path(WORD_BPE)), Counter()
    whole = encoder._whole
    words = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda new: sent.update(new) or words(new))
    name = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    for k in range(40):
        text = " ".join([f"often{name(i)}" for i in range(50)] + [f"rare{name(100 * k + i)}" for i in range(100)])
        assert [*encoder.encode([text])] == whole([text])
    assert {n for w, n in sent.items() if w.startswith("often")} == {1}


def test_all_characters_of_a_byte(monkeypatch):
    """Words go to the model alone, as the library would write them."""
    encoder, rng = token_files.CachedEncoder(public_tokenizers.path(WORD_BPE)), random.Random(7)
    assert encoder.model is not None
    texts = ["".join(rng.choices([chr(c) for c in range(256)], k=rng.randrange(60))) for _ in range(3000)]
    assert [*encoder.encode(texts)] == encoder._whole(texts)
