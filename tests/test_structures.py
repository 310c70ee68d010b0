"""Running values over ranges, section paths, mention spans, spans of time, labels and as-of lookups."""

import random
import re
from datetime import date, datetime

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import labels, ordering, recency, sections, spans


def same_as_sql(spark, tmp_path, name, frame_of, tables, sql):
    con = duckdb.connect()
    frames = {}
    for table, (rows, schema) in tables.items():
        frames[table] = spark.createDataFrame(rows, schema)
        frames[table].write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = frame_of(**frames)
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows and rows == sorted(answer.fetchall(), key=repr), name
    return rows


def test_running_values_like_windows_with_one_hot_group(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 8 + ["b", None]), r.choice([None, r.randint(-5, 50)])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "i long, g string, v int")
    got = ordering.running(frame, ["g"], ["i"], {"l": ("last", "v"), "m": ("max", "v"), "s": ("sum", "v")})
    state, want = {}, []
    for i, g, v in rows:
        last, most, total = state.get(g, (None, None, 0))
        want.append((i, g, v, last, most, total))
        if v is not None:
            state[g] = (v, v if most is None else max(most, v), total + v)
    assert sorted(map(tuple, got.collect())) == want


def stack_paths(heads):
    out, stack = [], []
    for pos, level, title in heads:
        title = (title or "").strip() or "Untitled Section"
        level = max(1, level or 1)
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append((pos, " > ".join(t for _, t in stack)))
    return out


def test_section_paths_like_a_stack(spark):
    r = random.Random(3)
    heads = {d: [(p, r.choice([None, 0, 1, 1, 2, 2, 3, 4, 5, 6]), r.choice(["A", "B", " c ", "", None])) for p in range(r.randint(1, 60))] for d in range(40)}
    rows = [(d, *h) for d, hs in heads.items() for h in hs]
    got = sections.section_paths(spark.createDataFrame(rows, "doc_id long, pos int, level int, title string").withColumn("path", F.lit("x")))
    assert sorted((x["doc_id"], x["pos"], x["path"]) for x in got.collect()) == sorted((d, p, t) for d, hs in heads.items() for p, t in stack_paths(hs))


def test_many_headings_in_one_document(spark):
    heads = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 5 + 1).cast("int").alias("level"), F.concat(F.lit("t"), "id").alias("title"))
    got = sections.section_paths(heads).where("pos = 99998").first()
    assert got["path"] == "t99995 > t99996 > t99997 > t99998"


def test_headings_of_texts_like_sql(spark, tmp_path):
    text = "REPORT\nIntroduction\n1. First Part\nSome text here, that ends.\n1.2 Second Part\n1.2.1 Deep\n# Marks\n## Below\ntext text\nCLOSING WORDS\nNotes and more\n2 Last Part"
    docs = [(1, text), (2, "Only one"), (3, ""), (4, None)]
    rows = same_as_sql(spark, tmp_path, "section_paths", lambda documents: sections.sections_with_paths(documents), {"documents": (docs, "doc_id long, text string")}, sections._SQL)
    assert len(rows) == 11


SENTENCES = "Anna Miller joined Acme Corp in Jan 2020. Bob Stone owes $1,200.50 to Delta Inc and Anna Miller! John Doe studied at Yale University for 3 years. Delta Inc invoiced € 30; Anna Miller was there 2024-01-31.\n"


def test_relations_of_rows_that_occur_like_sql(spark, tmp_path):
    docs = [(1, SENTENCES), (1, SENTENCES), (1, "Anna Miller met Bob Stone."), (2, SENTENCES * 3 + "Anna Miller" + " x" * 80 + " Bob Stone."), (3, None), (4, "")]
    rows = same_as_sql(spark, tmp_path, "typed_relations", lambda documents: spans.typed_relations(documents), {"documents": (docs, "doc_id long, text string")}, spans.queries()["typed_relations"][1])
    assert {r[5] for r in rows} == {"WORKED_AT", "STUDIED_AT", "OWES_TO", "ACTIVE_DURING", "RELATED_TO"}


def test_near_spans_like_every_pair(spark):
    r = random.Random(6)
    rows = [(r.choice("aab"), s, s + r.randint(1, 30), i) for i, s in enumerate(r.randint(0, 900) for _ in range(300))] + [("a", None, 3, 900), ("a", 3, None, 901), ("a", 5, 5, 902)]
    got = spans.near_spans(spark.createDataFrame(rows, "g string, start int, end int, i int"), ["g"], 25)
    want = sorted((x[3], y[3]) for x in rows[:300] for y in rows[:300] if x[0] == y[0] and 0 <= y[1] - x[2] <= 25)
    assert sorted((x["a"]["i"], x["b"]["i"]) for x in got.collect()) == want


def test_a_long_line_costs_its_bands_only(spark):
    text = "Anna Miller saw Bob Stone and then " * 30_000  # one sentence of 1 MB
    found = spans.near_spans(spans.mention_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")), ["doc_id", "copy", "sentence"])
    assert 60_000 < found.count() < 60_000 * 8


TIMES = "From 2019-2023, 2021 - present; 2020-01-01 to 2020-03-31, Q2 2020, Q4 2031 and FY 2018. 2025-2020 is no span, 2020-13-01 to 2020-14-01 neither. 2019-2023 again."


def test_times_of_texts_like_sql(spark, tmp_path):
    docs = [(1, TIMES), (2, "Q1 2001, Q2 2001, Q4 2001, FY2001"), (3, "1990–1991 1991—1995 1999 - now"), (4, None), (5, "")]
    tables = {"documents": (docs, "doc_id long, text string")}
    found = same_as_sql(spark, f"{tmp_path}/a", "temporal_spans", lambda documents: spans.temporal_spans(documents), tables, spans.queries()["temporal_spans"][1])
    assert (1, "quarter", "Q2 2020", date(2020, 4, 1), date(2020, 6, 30)) in found and len([r for r in found if r[0] == 1]) == 6
    islands = same_as_sql(spark, f"{tmp_path}/b", "temporal_coverage", lambda documents: spans.temporal_coverage(documents), tables, spans.queries()["temporal_coverage"][1])
    assert (1, 2, date(2019, 1, 1), None, 5) in islands


def plain_islands(rows):
    out = []
    for start, end in sorted(rows, key=lambda x: (x[0], 1 << 60 if x[1] is None else x[1])):
        reach = 1 << 60 if end is None else end
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], reach), out[-1][2] + 1)
        else:
            out.append((start, reach, 1))
    return [(s, None if e == 1 << 60 else e, n) for s, e, n in out]


@pytest.mark.parametrize("seed", range(3))
def test_islands_like_a_sweep(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in ("a", "a", "a", "b", None):
        rows += [(g, s, r.choice([None, *[s + r.randint(0, 9)] * 30])) for s in (r.randint(0, 400) for _ in range(60))]
    got = spans.coalesced(spark.createDataFrame([*rows, ("a", None, 3), ("a", 9, 3)], "g string, start int, end int"), ["g"])
    found = {}
    for x in got.orderBy("island").collect():
        found.setdefault(x["g"], []).append((x["start"], x["end"], x["n_spans"]))
    assert found == {g: plain_islands([x[1:] for x in rows if x[0] == g]) for g in ("a", "b", None)}


@settings(deadline=None, max_examples=150)
@given(st.text("ab. ", max_size=30), st.lists(st.text("ab.", min_size=1, max_size=4), max_size=6), st.lists(st.text("AB", min_size=1, max_size=3), max_size=3))
def test_phrases_like_a_search_for_each(text, first, second):
    present, hits = labels.Phrases({"x": first, "y": second}).counts(text)
    for k, phrases in enumerate((first, second)):
        distinct = {p.lower() for p in phrases}
        assert present[k] == sum(p in text for p in distinct)
        assert hits[k] == sum(len(re.findall(f"(?={re.escape(p)})", text)) for p in distinct)


def test_kinds_of_rows_that_occur_like_sql(spark, tmp_path):
    texts = ["Diploma of the University, a degree. Award and honor, best.", "Award and recognition; bachelor of a college", "Diagnosis: none. Prognosis good", "WHEREAS it is hereby entered into", "nothing", "", None, "Subtotal, amount due. Grand total"]
    docs = [(i, "a" if i % 2 else "b", t) for i, t in enumerate(texts)]
    schema = "doc_id long, source string, text string"
    rows = same_as_sql(spark, f"{tmp_path}/a", "section_kinds", lambda documents: labels.section_kinds(documents), {"documents": (docs, schema)}, labels.queries()["section_kinds"][1])
    assert {r[1] for r in rows} == {"education", "medical_findings", "legal_preamble", "financial_summary", "section_text"}
    same_as_sql(spark, f"{tmp_path}/b", "kind_statistics", lambda documents: labels.kind_statistics(documents), {"documents": (docs, schema)}, labels.queries()["kind_statistics"][1])


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_like_a_search_back(spark, inclusive):
    r = random.Random(9)
    left = [(g, r.choice([None, *range(60)]), i) for i, g in enumerate(r.choice(["a", "a", "a", "b", None]) for _ in range(400))]
    right = [(g, r.choice([None, *range(60)]), r.choice([None, *range(9)])) for g in (r.choice(["a", "a", "b", "c", None]) for _ in range(120))]
    got = recency.as_of(spark.createDataFrame(left, "g string, t int, id int"), spark.createDataFrame(right, "g string, t int, v int"), ["g"], "t", ["v"], inclusive)
    assert got.columns == ["g", "t", "id", "asof_t", "asof_v"]
    low = lambda v: -1 if v is None else v
    want = []
    for g, t, i in left:
        before = [(rt, low(v), v) for rg, rt, v in right if rg == g and rt is not None and t is not None and (rt < t or (inclusive and rt == t))]
        best = max(before, default=(None, None, None))
        want.append((g, t, i, best[0], best[2]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert recency.as_of(spark.createDataFrame([], "g string, t int"), spark.createDataFrame(right, "g string, t int, v int"), ["g"], "t", ["v"]).count() == 0


def test_one_long_conversation(spark):
    turns = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("Entity"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).otherwise("x").alias("text"))
    got = {r["turn"]: r for r in recency.last_mentions(turns).where("turn in (0, 1, 5, 1001, 99999)").collect()}
    assert (got[0]["asof_turn"], got[1]["asof_turn"], got[5]["recency"], got[1001]["asof_turn"], got[99999]["recency"]) == (None, 0, 0.4, 1000, 0.0)


def test_numbers_and_words_that_were_said_before(spark, tmp_path):
    from scriptorium.operators import evidence

    turns = [(1, 0, "user", "We sold 1,234 units and 7 in 2023 at 45% of 99.5"), (1, 1, "assistant", "You sold 1,234 units, 20 boxes and 888 in 2023. Nothing else. 99.5!"), (1, 2, "user", "And 888?"), (1, 3, "assistant", "888 units. 777 too"), (1, 4, "assistant", ""), (2, 0, "assistant", "Hello 555"), (2, 1, "user", None)]
    tables = {"conversations": (turns, "conv_id long, turn long, role string, text string")}
    for name, of in (("numeric_precision", evidence.numeric_precision), ("evidence_coverage", evidence.evidence_coverage), ("low_provenance", evidence.provenance)):
        rows = same_as_sql(spark, f"{tmp_path}/{name}", name, lambda conversations, of=of: of(conversations), tables, evidence.queries()[name][1])
        if name == "numeric_precision":
            assert (1, 1, 4, 0.75) in rows and (1, 3, 2, 0.5) in rows
    silent = spark.createDataFrame([(3, 0, "assistant", None), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in evidence.numeric_precision(silent).collect()] == [(3, 0, 0, 1.0)]
    assert evidence.evidence_coverage(silent).count() == evidence.provenance(silent).count() == 0


def test_forms_causes_and_merges_of_rows_that_occur_like_sql(spark, tmp_path):
    from scriptorium.operators import extraction

    form = "Name: John Smith\nAge\t41\nCity   Rome\nnote: none\nThis is prose: really\nAddress:\n   12 High Street\nName: john smith\nEmpty:\n\nname\tJohn Smith\nA: b\nOne two three four five six seven eight nine: ten"
    causes = "Sales sincerely fell since prices rose in May. The storm led to long delays! It rained. Since noon\nProfit was due to luck; costs are down. As a result we stayed at home, however. Lights resulted  in a fire here. The cut triggered more cuts. Heat induced the failure of pumps."
    docs = [(1, form), (2, causes), (3, ("alpha beta gamma delta epsilon zeta " * 20).strip()), (4, None), (5, "")]
    for name in ("form_fields", "causal_links", "recommended_merges"):
        query, sql = extraction.queries()[name]
        of = lambda documents, query=query, name=name: query(spark, f"{tmp_path}/{name}")
        rows = same_as_sql(spark, f"{tmp_path}/{name}", name, of, {"documents": (docs, "doc_id long, text string")}, sql)
        if name == "form_fields":
            assert {(r[1], r[3], r[4]) for r in rows} == {("name", 0.9, 0), ("age", 0.7, 1), ("city", 0.7, 2), ("address", 0.9, 5)}
        if name == "causal_links":
            assert len(rows) == 5 and (2, 1, "since", "prices rose in May", "Sales sincerely fell") in rows and (2, 2, "led to", "The storm", "long delays") in rows


def test_a_sentence_at_just_the_threshold_is_supported(spark, tmp_path):
    """Three of ten words are 0.3, the threshold of up to two sentences."""
    from scriptorium.operators import evidence

    turns = [(1, 0, "user", "a b c"), (1, 1, "assistant", "a b c d e f g h i j."), (2, 0, "user", "a b c d e f g h i"), (2, 1, "assistant", " ".join("abcdefghijklmnopqrst") + ". a. a. a. a.")]
    rows = same_as_sql(spark, str(tmp_path), "evidence_coverage", lambda conversations: evidence.evidence_coverage(conversations), {"conversations": (turns, "conv_id long, turn long, role string, text string")}, evidence.queries()["evidence_coverage"][1])
    assert sorted(rows) == [(1, 1, 1, 1, 0, 1.0), (2, 1, 5, 5, 0, 1.0)]


def test_passives_and_identifiers_beside_letters_outside_ascii(spark, tmp_path):
    """SQL's word boundary is that of ASCII: it stands between a letter with an accent and one without."""
    from scriptorium.operators import quality

    texts = ["Le p\u00e8am tested it. It was tested\u00e9.", "\u00e910.1234/ab and 10.1234/ab\u00e9", "wa\u017f tested, was\x0btested, IS\tUSED", "es was is used\u00e9ed", ""]
    rows = same_as_sql(spark, str(tmp_path), "hedging_and_voice", lambda documents: quality.hedging_and_voice(documents), {"documents": (list(enumerate(texts)), "doc_id long, text string")}, quality.queries()["hedging_and_voice"][1])
    assert [r[2] for r in rows] == [2, 0, 2, 1, 0] and rows[1][4] == 2


def test_units_beside_letters_outside_ascii(spark, tmp_path):
    from scriptorium.operators import screening

    texts = ["12 kg\u00e9 and 12 mm", "\u00e95 m, 5 km", "7\x0bkg 7 g 7 kg", "3% 3%x 3 x 3_y"]
    rows = same_as_sql(spark, str(tmp_path), "numeric_units", lambda documents: screening.numeric_units(documents), {"documents": (list(enumerate(texts)), "doc_id long, text string")}, screening.queries()["numeric_units"][1])
    assert rows[:3] == [(0, "12", 2, 2), (1, "5", 2, 2), (2, "7", 2, 2)]


def test_stale_users_by_whole_hours_of_exact_times(spark, tmp_path):
    """Parts of a second count; events without a type tell no state, and without a time or id they come last."""
    from scriptorium.operators import evidence

    at = datetime.fromisoformat
    events = [(0, 1, at("2024-01-05T00:00:00.200000"), "view"), (1, 2, at("2024-01-03T00:00:00.900000"), "click"), (2, 3, at("2024-01-03T00:00:00.200000"), "error"), (3, 3, at("2024-01-03T00:00:00.200000"), None)]
    events += [(4, 4, at("2024-01-02T00:00:00"), "view"), (5, 4, None, "signup"), (None, 5, at("2024-01-01T00:00:00"), "view"), (6, 5, at("2024-01-01T00:00:00"), "click")]
    rows = same_as_sql(spark, str(tmp_path), "stale_users", lambda events: evidence.stale(events), {"events": (events, "event_id long, user_id long, ts timestamp_ntz, event_type string")}, evidence.queries()["stale_users"][1])
    assert rows == [(2, "click", 47), (3, "error", 48), (4, "signup", 72), (5, "view", 96)]
