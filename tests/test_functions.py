"""Expressions and kernels on hand-written rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import dedupe, kernels, metrics, retrieval, screening, structure
from scriptorium.sources import files, tables


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "expected"), [("about 1,250.5 units", 1250.5), ("$3.5M raised", 3.5e6), ("12K", 12000.0), ("none", None), ("", None)])
def test_numbers(spark, given, expected):
    assert one(spark, T.parse_number(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("given", "expected"), [("2024-03-05 x", 20240305), ("3/5/24", 20240305), ("Q2 2023", 20230401), ("FY2021", 20210101), ("1999", 19990101), ("soon", 0)])
def test_date_keys(spark, given, expected):
    assert one(spark, T.date_sort_key(F.col("t")), t=given) == expected


def test_secrets_are_masked(spark):
    assert one(spark, screening.redacted(F.col("t")), t="password: hunter2 and api_key=abc") == "password=[REDACTED] and api_key=[REDACTED]"
    assert one(spark, screening.mask(F.col("t")), t="short") == "***"
    assert one(spark, screening.mask(F.col("t")), t="someone@example.com") == "so***.com"
    docs = spark.createDataFrame([(1, "call 555-123-4567 or 10.1.2.3, id 123-45-6789, a@b.org"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in screening.pii_counts(docs).collect()}
    assert (got[1].emails, got[1].ids, got[1].phones) == (1, 1, 1) and got[3].pii_count == 0
    assert {r.doc_id: r.private_addresses for r in screening.secrets(docs).collect()}[1] == 1


def test_text_normal_forms(spark):
    assert one(spark, T.normalized(F.col("t")), t=" a \t b\n\n\n\nc\x00 ") == "a b\n\nc"
    assert one(spark, T.reflowed(F.col("t")), t="exam-\nple text\nPage 3 of 9\nmore") == "example text\nmore"
    assert one(spark, T.overlap_prefix(F.split("a", " "), F.split("b", " ")), a="x y z", b="y z w") == 2
    assert one(spark, T.flesch(F.col("t")), t="") == 0.0


def test_simhash_is_that_of_the_tokens(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "The quick, brown fox! the QUICK")], "doc_id long, text string")
    got = dedupe.simhash(docs).first()
    votes = [0] * 64
    for token in "the quick brown fox the quick".split():
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    assert got.high << 32 | got.low == sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for operator in (dedupe.simhash_pairs, dedupe.jaccard_pairs, structure.token_windows, structure.packed_sentences, metrics.majority_domain, retrieval.tfidf_top_terms):
        assert operator(docs).count() == 0


def test_packing_is_greedy(spark):
    docs = spark.createDataFrame([(1, "aaaa. bbbb. cccc. " + "d" * 30 + ". ee.")], "doc_id long, text string")
    got = sorted((r.chunk_index, r.n_sentences, r.n_chars) for r in structure.packed_sentences(docs, 12).collect())
    assert got == [(0, 2, 11), (1, 1, 5), (2, 1, 31), (3, 1, 3)]


def test_diverse_bundles():
    pool = np.array([[1.0, 0.0], [0.99, 0.14], [0.7, 0.71]])
    assert kernels.mmr_order(np.array([0.8, 0.6]), pool / np.linalg.norm(pool, axis=1, keepdims=True), 2, 0.5) == [2, 0]


def test_scope_and_select_guards(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "de")], "doc_id long, source string, lang string")
    assert [r.doc_id for r in tables.scoped(docs, profile="b", lang=["de", "fr"]).collect()] == [2]
    with pytest.raises(ValueError, match="profile"):
        tables.scoped(docs, profile=" ")
    for bad in ("drop table x", "select 1; delete from x", "update x set a = 1"):
        with pytest.raises(ValueError, match="SELECT"):
            tables.select_only(bad)
    assert tables.run_select(spark, "select 1 as a").first().a == 1


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k long, v string")
    assert sorted((r.k or 0, r.v) for r in files.upserted(old, new, ["k"]).collect()) == [(0, "e"), (1, "a"), (2, "c"), (3, "d")]
    assert sorted(r.k for r in files.changed(old, new, "k", "v").collect()) == [2, 3]
    assert [r.k for r in files.deleted(old, new, ["k"]).collect()] == [1]
    files.write_json_lines(old, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    vectors = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert files.checked_vectors(vectors, "v", 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        files.checked_vectors(vectors, "v", 3).collect()


def test_files_of_several_kinds(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.csv").write_text("name,age\nAda,36\n")
    (tmp_path / "c.json").write_text('{"b": 1, "a": [2]}')
    (tmp_path / "d.docx").write_bytes(b"not a zip file")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:p><w:r><w:t>Hello </w:t><w:t>Word</w:t></w:r></w:p></w:document>')
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text, bool(r.error)) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "plain text", False), "b.csv": ("table", "name: Ada; age: 36", False), "c.json": ("json", '{"a": [2], "b": 1}', False), "d.docx": ("word", "", True), "e.docx": ("word", "Hello Word", False)}
