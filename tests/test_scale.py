"""Plans that spread work: places by ranges, searches in blocks and parts, intermediate tables."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import window as W

from scriptorium.operators import dedupe, ordering, retrieval, rules, search
from scriptorium.sources import files, tables


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def random_texts(spark, n, words, vocabulary, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice("abcdefghij") + f"{r.randrange(vocabulary)}x" for _ in range(words)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sum(map(len, texts))


def test_set_joins_shuffle_little_of_the_sets(spark):
    """Only the rarest words, and whole sets of candidates alone: of these texts no two are alike."""
    docs, size = random_texts(spark, 400, 400, 10_000, 5)
    for operator in (dedupe.jaccard_pairs, rules.greedy_jaccard):
        before = shuffled(spark)
        assert operator(docs).count() == (400 if operator is rules.greedy_jaccard else 0)
        assert shuffled(spark) - before < 2 * size


def test_places_like_a_window(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.randint(0, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, g string, v int")
    w = W.Window.partitionBy("g")
    want = frame.select("id", F.row_number().over(w.orderBy("v", "id")).alias("place"), F.count("*").over(w).alias("group_rows"))
    got = ordering.placed(frame, ["g"], ["v", "id"])
    assert got.columns == ["id", "g", "v", "place", "group_rows"]
    assert sorted(map(tuple, got.select("id", "place", "group_rows").collect())) == sorted(map(tuple, want.collect()))
    assert ordering.placed(frame.limit(0), ["g"], ["v", "id"]).count() == 0


def test_blocks_and_parts_do_not_change_searches(spark, monkeypatch):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice("alpha beta gamma delta epsilon".split()) for _ in range(r.randint(0, 12)))) for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(r.sample("alpha beta gamma delta zeta".split(), 2))) for i in range(30)] + [(99, None)], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None)], "vec_id long, embedding array<float>")
    find = lambda: [sorted(map(tuple, x.collect())) for x in (retrieval.bm25(docs, items), retrieval.keyword_f1(docs, items), retrieval.cosine_topk(vectors, 5, 10))]
    whole = find()
    monkeypatch.setattr(search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(search, "PART_ROWS", 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    assert find() == whole and all(whole)
    assert retrieval.bm25(docs.limit(0), items).count() == retrieval.bm25(docs, items.limit(0)).count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    with tables.scratch(spark):
        gone = tables.durable(spark.range(3), "gone")
        with tables.scratch(spark):
            inner = tables.durable(spark.range(4), "inner", keep=True)
        assert gone.count() == 3 and inner.count() == 4
        stays = tables.durable(spark.range(5), "stays", keep=True)
    assert stays.count() == 5
    for table in (gone, inner):
        with pytest.raises(Exception, match="(?i)file|path"):
            table.count()


def test_spreadsheets_are_read_from_their_xml():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><r><t>an</t></r><r><t>na</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert files.extract("sheet", data.getvalue()) == ("name: anna; : ; age: 7", "")
    assert files.extract("sheet", b"broken")[1]


def test_simhashes_without_a_shuffle_of_tokens(spark):
    docs, size = random_texts(spark, 400, 400, 10_000, 6)
    before = shuffled(spark)
    got = dedupe.simhash(docs).collect()
    assert len(got) == 400 and shuffled(spark) - before < size / 10
    again = docs.unionAll(docs.where("doc_id < 2")).unionAll(docs.where("doc_id < 3").selectExpr("cast(null as long) as doc_id", "text"))
    three = dedupe.simhash(again).collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in three if x.doc_id is not None} and len(three) == 401


def test_simhash_pairs_once_each_without_a_shuffle_of_pairs(spark):
    """Texts that share most of their words: every pair is near by many keys, and counts once."""
    r = random.Random(8)
    common = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*common, *(f"v{r.randrange(10**6)}" for _ in range(4))])) for i in range(300)], "doc_id long, text string")
    hashes = {x.doc_id: x.high << 32 | x.low for x in dedupe.simhash(docs).collect()}
    first = {}
    for i, h in sorted(hashes.items()):
        first.setdefault(h, i)
    want = sorted((a, b, (x ^ y).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 5)
    before = shuffled(spark)
    got = sorted(map(tuple, dedupe.simhash_pairs(docs).collect()))
    assert got == want and len(want) > 1000
    assert shuffled(spark) - before < 40 * 56 * len(first)


def test_top_terms_shuffle_likely_ones_only_and_are_the_same_by_loose_bounds(spark, tmp_path, monkeypatch):
    import duckdb

    docs, size = random_texts(spark, 400, 400, 300, 7)
    before = shuffled(spark)
    got = sorted(map(tuple, retrieval.tfidf_top_terms(docs).collect()))
    assert len(got) == 2000 and shuffled(spark) - before < size
    odd = spark.createDataFrame([(1, "aa bb cc"), (1, "dd aa ee ff gg"), (None, "zz yy"), (None, "zz"), (900, ""), (901, None), (902, "x"), (903, "aa bb cc dd ee ff gg hh")], "doc_id long, text string")
    docs.unionAll(odd).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(retrieval.queries()["tfidf_top_terms"][1]).fetchall(), key=repr)
    for buckets in (retrieval.BUCKETS, 4):
        monkeypatch.setattr(retrieval, "BUCKETS", buckets)
        rows = sorted(map(tuple, retrieval.tfidf_top_terms(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()), key=repr)
        assert [r[:3] for r in rows] == [r[:3] for r in want]
        assert [r[3] for r in rows] == pytest.approx([r[3] for r in want], abs=1e-12)
