"""Packed token ids: kernels against plain Python, whole files against the public library."""

import functools
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import token_files as T


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
def test_packing_is_the_plain_bit_string_and_undoes(width, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    words = T.pack(ids, width)
    number = sum(int(v) << (k * width) for k, v in enumerate(ids))
    assert int.from_bytes(words.tobytes(), "little") == number
    assert T.unpack(words, width)[:n].tolist() == ids.tolist()


def test_an_id_too_large_for_the_width_is_refused():
    with pytest.raises(ValueError):
        T.pack(np.array([8], np.uint32), 3)
    assert [T.width_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_random_access_reads_single_blocks_and_notices_damage():
    rng = np.random.default_rng(2)
    counts = np.array([1, 500, 64, 3])
    ids = rng.integers(0, 1 << 11, counts.sum()).astype(np.uint32)
    raw = T.shard([4, 5, None, 9], counts, ids, 11, 3, 1000, block_ids=64)
    file = T.Shard(io.BytesIO(raw + b"\n"))
    assert (file.doc_ids, file.part, file.start, file.n_ids) == ([4, 5, None, 9], 3, 1000, 568)
    assert file.document(1).tolist() == ids[1:501].tolist()
    for low, high in ((0, 0), (0, 1), (63, 65), (64, 128), (130, 568), (568, 568)):
        assert file.ids(low, high).tolist() == ids[low:high].tolist()
    bad = bytearray(raw)
    bad[-1] ^= 1
    damaged = T.Shard(bytes(bad))
    assert damaged.ids(0, 64).tolist() == ids[:64].tolist()  # other blocks are not read
    with pytest.raises(ValueError):
        damaged.ids(560, 568)
    with pytest.raises(ValueError):
        T.Shard(raw[:-8]).document(3)
    with pytest.raises(ValueError):
        T.shard([1], np.array([1]), ids[:1], 11, 0, 0, block_ids=100)


TEXTS = ["", None, "  ", "One two  TWO\tthree\nfour", "don't we'll it's 12 3.5", "Amélie É é İstanbul ΣΑΣ 　wide blank", "́mark first", "a" * 5000, "x<|endoftext|>y <|startoftext|>", "日本語 🙂🙂 \x00 \x1c", "same text", "same text"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def expected(texts):
    coder = library()
    return [coder.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_stretches_give_the_library_s_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "CACHE_STRETCHES", 5)
    coder = T.StretchEncoder(T.default_tokenizer())
    for some in (TEXTS, TEXTS[::-1], []):
        ids, counts = coder.encode(pa.array(some, pa.string()), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(some)] == expected(some)


def test_plain_characters_are_left_alone_by_normal_forms():
    import unicodedata

    import pyarrow as pa
    import pyarrow.compute as pc

    for c in map(chr, range(0x180)):
        if T.PLAIN.fullmatch(c):
            assert unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1
            assert pc.utf8_lower(pa.scalar(c)).as_py() == c.lower() == library().normalizer.normalize_str(c)
            assert bool(T.PIECE.fullmatch(c.lower() * 2)) == (unicodedata.category(c)[0] in "LPS")  # digits stand alone


@settings(deadline=None, max_examples=2000)
@given(st.text(max_size=60) | st.text("aAzZ09'stredlmv.,-_<|>ÀÉßÿœŒŠİı×÷ſŉ²µ\t \u0301", max_size=40) | st.text(st.characters(max_codepoint=0x17F), max_size=30))
def test_any_text_gives_the_library_s_ids(text):
    import pyarrow as pa

    ids, _ = T.encoder(T.default_tokenizer()).encode(pa.array([text], pa.string()), 2)
    assert ids.tolist() == expected([text])[0]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(100 - 7 * k, t, k) for k, t in enumerate(TEXTS)] + [(None, "no id", 0), (100, "repeated id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    T.write_ids(docs, f"{tmp_path}/ids", shard_ids=40, block_ids=64)
    found = sorted(T.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = {}
    for (key, _, _), ids in zip(rows, expected([r[1] for r in rows]), strict=True):
        want.setdefault(key, []).append(ids)
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids"] in want[r["doc_id"]]
        want[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    digests = {(r["start"], r["n_tokens"]): r["ids_crc32"] for r in T.read_digests(spark, f"{tmp_path}/ids").collect()}
    assert digests == {(r["start"], r["n_tokens"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in found}


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    T.write_ids(docs, f"{tmp_path}/ids")
    assert T.read_digests(spark, f"{tmp_path}/ids").count() == 0


def test_the_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at, want = 0, []
    for (key, _), ids in zip(texts, expected([t for _, t in texts]), strict=True):
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = T.op13_token_files(spark, sf).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
