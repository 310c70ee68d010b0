"""Name resolution as a join: keys, pairs, leaders and the whole against every pair compared."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.operators import kernels, resolution


def greedy(names, least=0.85):
    """Names in order of their rank to their leaders, every leader tried."""
    led, out = [], {}
    for name in names:
        out[name] = next((x for x in led if kernels.same_name(name, x, least)), name)
        if out[name] == name:
            led.append(name)
    return out


NAMES = st.text("abce. ", min_size=1, max_size=12).map(str.strip).filter(bool)


@settings(deadline=None, max_examples=400)
@given(st.lists(NAMES, min_size=2, max_size=12), st.sampled_from([0.75, 0.85, 0.93]))
def test_names_that_are_the_same_share_a_key(names, least):
    keys = [resolution.keys_of(x, least) for x in names]
    for i, a in enumerate(names):
        for j in range(i):
            if kernels.same_name(a, names[j], least):
                assert keys[i] & keys[j], (a, names[j])


@settings(deadline=None, max_examples=300)
@given(NAMES, st.data())
def test_an_edited_name_still_shares_a_key(name, data):
    at = data.draw(st.integers(0, len(name)))
    other = (name[:at] + data.draw(st.sampled_from("abxyz")) + name[at + data.draw(st.integers(0, 1)) :]).strip()
    if kernels.same_name(name, other, 0.85):
        assert resolution.keys_of(name, 0.85) & resolution.keys_of(other, 0.85)


def names_for(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(3, 7)))
    return sorted({f"{r.choice([word(), word(), word()[0], word()[0] + '.'])} {word()}" for _ in range(n)} | {"jonathan smith", "jonathan msith", "j. smith", "smith"})


@pytest.mark.parametrize("part_names", [5, 4096])
def test_the_join_equals_every_pair(spark, part_names):
    names = names_for(2, 150)
    frame = spark.createDataFrame([("x", n, float(i % 4)) for i, n in enumerate(names)], "label string, name string, confidence double")
    found = sorted((r["name"], r["earlier"]) for r in resolution.same_names(frame, 0.85, part_names).collect())
    order = sorted(range(len(names)), key=lambda i: (-(i % 4), names[i]))
    want = sorted((names[b], names[a]) for k, b in enumerate(order) for a in order[:k] if kernels.same_name(names[a], names[b], 0.85))
    assert found == want and len(want) > 50


def test_leaders_in_rounds_equal_the_greedy_order(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(90)}) + [(k, k + 1) for k in range(200, 215)]
    same = spark.createDataFrame([("x", str(b), str(a)) for a, b in pairs], "label string, name string, earlier string")
    kept = []
    for i in sorted({x for p in pairs for x in p}):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert sorted(int(x["name"]) for x in resolution.leaders(same).collect()) == kept


@pytest.mark.parametrize(("first_batch", "part_names"), [(512, 4096), (7, 5)])
def test_whole_resolution_equals_the_greedy_order(spark, first_batch, part_names):
    names = names_for(3, 200)
    frame = spark.createDataFrame([(lab, n.title(), float(len(n) % 5)) for lab in ("a", "b") for n in names[:: 1 if lab == "a" else 3]], "label string, name string, confidence double")
    found = {(r["label"], r["name"].lower()): r["leader"].lower() for r in resolution.resolved(frame, part_names=part_names, first_batch=first_batch).collect()}
    for lab, step in (("a", 1), ("b", 3)):
        order = sorted(names[::step], key=lambda n: (-(len(n) % 5), n.title()))
        assert {n: v for (k, n), v in found.items() if k == lab} == greedy(order)


def test_titles_suffixes_initials_and_odd_rows(spark):
    rows = [("p", "John Smith", 0.9), ("p", "Dr. John Smith", 0.9), ("p", "John Smith Jr.", 0.8), ("p", "J. Smith", 0.7), ("p", "Mr. Smith", 0.6), ("p", "Sarah Chen", 0.5)]
    rows += [("o", "Google", 0.9), ("o", "Google Inc.", 0.8), ("q", "John Smith", 0.1), (None, "John Smith", 0.1), ("p", None, 1.0), ("p", "", 0.3), ("p", "Sarah Chen", 0.4)]
    frame = spark.createDataFrame(rows, "label string, name string, confidence double").withColumn("clean", resolution.F.lit("x"))
    people = {(r["label"], r["name"]): r["leader"] for r in resolution.resolved(frame).collect()}
    smiths = {("p", n): "Dr. John Smith" for n in ("John Smith", "Dr. John Smith", "John Smith Jr.", "J. Smith", "Mr. Smith")}
    assert {k: v for k, v in people.items() if k[0] == "p"} == smiths | {("p", "Sarah Chen"): "Sarah Chen", ("p", ""): ""}
    assert people["q", "John Smith"] == people[None, "John Smith"] == "John Smith"
    organisations = {(r["label"], r["name"]): r["leader"] for r in resolution.resolved(frame, clean=resolution.organisation).collect()}
    assert organisations["o", "Google Inc."] == "Google"
    assert resolution.resolved(frame.limit(0)).count() == 0
    long = spark.createDataFrame([("p", f"Aa{'b' * 50_000} Smith{k}", 1.0) for k in range(3)], "label string, name string, confidence double")
    assert all(r["name"] == r["leader"] for r in resolution.resolved(long).collect())


def test_names_across_first_letters_and_initials(spark):
    text = "Katherine Miller. " * 3 + "Catherine Miller, Jonathan Smith; Jonathan Smith, Jonathan Msith. J. Smith"
    got = resolution.resolved_names(spark.createDataFrame([("en", text), ("de", "Catherine Miller"), ("fr", None)], "lang string, text string")).collect()
    want = {("en", "Katherine Miller"): "Katherine Miller", ("en", "Catherine Miller"): "Katherine Miller", ("de", "Catherine Miller"): "Catherine Miller"}
    assert {(x.label, x.name): x.leader for x in got} == want | {("en", x): "Jonathan Smith" for x in ("Jonathan Smith", "Jonathan Msith", "J. Smith")}
