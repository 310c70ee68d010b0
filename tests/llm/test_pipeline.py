"""The pipeline on a small corpus, against what each stage must do."""

import corpus_pipeline
from scriptorium.llm import bpe
from scriptorium.llm.queries import oracle_sql, queries


def words(prefix, n):
    return " ".join(f"{prefix}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(n))


def test_stages_take_effect(spark, tmp_path):
    clean, other, item = words("alpha", 60), words("beta", 60), words("gamma", 30)
    shared = "this line is found in more than one document"
    docs = [
        (0, clean, "en"),
        (1, clean.replace("alphazz", "x") + " changed", "en"),  # a near copy of 0
        (2, f"{shared}\n{other}", "en"),
        (3, f"{shared}\n{words('delta', 60)}", "en"),
        (4, f"start {item} end", "en"),  # leaked
        (5, "12345 !!!", "en"),  # no language
        (6, None, "en"),
        (7, shared, "en"),  # nothing left after line dedup
        (8, "Tiny.", "en"),
    ]
    rows = [(d, t, lang, "src", len(t or "")) for d, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 2, 3, 8]
    coder = bpe.encoder(*bpe.default_tokenizer())
    assert got[2].ids == coder.encode(f"{shared}\n{other}") and got[3].ids == coder.encode(words("delta", 60))
    assert all(x.n_tokens == len(x.ids) for x in got.values())


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(1, "some words in a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_and_awkward_tables(spark, tmp_path):
    """No documents; repeated rows, equal texts, nulls everywhere and columns that clash with the stages' own."""
    spark.createDataFrame([(0, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "Some words that make a line of a document.\nAnd another line, which is longer than the one before it."
    rows = [(1, text, "en", "s", 3, 7), (1, text, "en", "s", 3, 7), (2, text, "en", "s", 3, 7), (None, text, None, None, None, None), (3, None, "en", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((x.doc_id or 0) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 1]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fragments_of_near_copies_go(spark, tmp_path):
    """What line dedup leaves of a near copy is like nothing else; the copy goes for what it was before."""
    lines = [words(f"p{chr(97 + i)}", 30) for i in range(8)]
    copy = lines[:4] + [lines[4].replace("peaa", "qqq").replace("peba", "rrr").replace("peca", "sss")] + lines[5:]
    rows = [(i, "\n".join(t), "en", "s", 1) for i, t in enumerate((lines, copy, [words("other", 40)]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 2]


def test_every_operator_has_a_query():
    assert sorted({int(q[2:].split("_")[0]) for q in queries() if q.startswith("op")}) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
