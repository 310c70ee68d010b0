"""Line and document deduplication against brute force, and their edge cases."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from scriptorium.llm import graph, line_dedup, near_dedup

DOCS = "doc_id long, text string"


def near(a: str, b: str) -> bool:
    """One substitution, insertion or deletion apart, or equal."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(docs, least):
    lines = [(d, n, line) for d, t in sorted(docs) for n, line in enumerate(t.split("\n"))]
    kept = {}
    for i, (d, n, line) in enumerate(lines):
        gone = len(line) >= least and any(near(line, other) for _, _, other in lines[:i] if len(other) >= least)
        kept.setdefault(d, []).extend([] if gone else [line])
    return {d: "\n".join(x) for d, x in kept.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_like_brute_force(spark, seed):
    r = random.Random(seed)
    bases = ["".join(r.choice("abé ") for _ in range(r.randint(3, 14))) for _ in range(12)]
    docs = []
    for d in range(25):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(bases))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(line) + 1)
                line[at : at + r.randint(0, 1)] = r.choice([[], ["x"], ["a"]])
            lines.append("".join(line))
        docs.append((d, "\n".join(lines)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), least=4)
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(docs, 4)


def test_lines_edge_cases(spark):
    long = "x" * 30_000
    rows = [(1, None, "k"), (2, "", "k"), (None, "a line that is long enough", "k"), (3, "a line that is long enough\nshort\nshort", "k"), (4, "a line that is long enough\nshort", "k"), (4, "a line that is long enough\nshort", "k"), (5, long, "k"), (6, long[:-1], "k"), (7, "a line that is long enoug\nz", "k")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS + ", n_dropped string"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    texts = [(x.doc_id, x.text, x.n_dropped) for x in got.collect()]
    assert sorted(texts, key=repr) == sorted([(1, None, 0), (2, "", 0), (None, rows[2][1], 0), (3, rows[3][1], 0), (4, "short", 1), (4, "short", 1), (5, long, 0), (6, "", 1), (7, "z", 1)], key=repr)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="bound"):
        line_dedup.dedup_lines(spark.createDataFrame([], DOCS), max_edits=2)


def test_very_long_lines_and_texts_of_many_lines(spark):
    """The work follows the length of a line, whether it is all alike or not, and the number of a text's lines."""
    r = random.Random(3)
    mixed = "".join(r.choice("abcdefgh ") for _ in range(120_000))
    alike = "y" * 60_000
    many = "\n".join(f"line number {i} of a long text, {r.random()}" for i in range(20_000))
    rows = [(1, mixed), (2, mixed[:60_000] + "#" + mixed[60_001:]), (3, mixed[:-1]), (4, alike), (5, alike + "y"), (6, many), (7, many.split("\n")[7_777] + "\nThis line is new here.")]
    began = time.time()
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[k].text == t for k, t in rows] == [True, False, False, True, False, True, False]
    assert [got[k].n_dropped for k, _ in rows] == [0, 1, 1, 0, 1, 0, 1]
    assert got[7].text == "This line is new here."
    assert time.time() - began < 120


def words_apart(a: str, b: str) -> bool:
    """One word replaced, put in or left out; longer words count in pieces of 20 characters."""
    a, b = sorted((re.findall("[^ ]{1,20} ?| ", x + " ") for x in (a, b)), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", [1, 2])
def test_long_lines_by_words_like_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.choice([1, 3, 6, 19, 20, 21, 45])))
    bases = [[word() for _ in range(r.randint(1, 14))] for _ in range(10)]
    lines = []
    for _ in range(160):
        line = list(r.choice(bases))
        for _ in range(r.randint(0, 2)):
            at = r.choice([0, len(line), r.randrange(len(line) + 1)])
            line[at : at + r.randint(0, 1)] = r.choice([[], [word()], [""]])
        lines.append(" ".join(line))
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), DOCS), max_words=1)
    gone = {i for i, x in enumerate(lines) if len(x) >= 16 and any(near(x, y) or (min(len(x), len(y)) >= 100 and words_apart(x, y)) for y in lines[:i] if len(y) >= 16)}
    assert {x.doc_id for x in got.collect() if x.n_dropped} == gone
    assert any(not any(near(lines[i], y) for y in lines[:i]) for i in gone)


def test_short_lines_go_if_equal(spark):
    rows = [(1, "Les.\n\n  \nOf, edti oner.\nx\n}"), (2, "Les.\n\n  \nOf, edti oner!\nx\na line that is long enough"), (3, "}\na line that is long enouch")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), least_equal=1)
    assert {x.doc_id: x.text for x in got.collect()} == {1: rows[0][1], 2: "\n  \nOf, edti oner!\na line that is long enough", 3: ""}


def shingles(text, width):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_components(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


def chain(r, n, words):
    """Texts each a few words from the one before, so that the ends are only linked through the middle."""
    text = [r.choice(words) for _ in range(120)]
    for _ in range(n):
        yield " ".join(text)
        text = text[:]
        text[r.randrange(len(text))] = r.choice(words)


def test_near_duplicates_like_brute_force(spark):
    r = random.Random(5)
    words = [f"Wort{i}é" for i in range(400)]
    texts = [t for _ in range(6) for t in chain(r, 12, words)] + [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["one", "One", "one two", "ONE two", "", "  "]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(docs, 3, 85)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(9, long, 1), (3, long + " end", 1), (5, None, 1), (6, "", 1), (None, "same old text", 1), (7, "same old text", 1), (7, "same old text", 1), (8, "same old text", 1)]
    docs = spark.createDataFrame(rows, DOCS + ", component_id int")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert got == sorted([(9, 3, False), (3, 3, True), (5, 5, True), (6, 6, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 7, False)], key=repr)
    kept = near_dedup.deduplicated(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 3, 5, 6, 7, 7]
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_both_versions_of_texts_at_once(spark, monkeypatch):
    """Links of either version join documents, none crosses versions, and no table is made once for each version."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]

    def texts():
        found = [t for _ in range(5) for t in chain(r, 4, words)] + [" ".join(r.choice(words) for _ in range(40)) for _ in range(26)]
        r.shuffle(found)
        return [*found, "same old text of some words", found[0], None, ""]

    now, old = (dict(enumerate(texts())) for _ in range(2))
    now[50] = old[51] = "what one is now and the other was before"
    now[51], old[50] = "something else that is left of it", "and this is how it began at first"
    parent = {d: d for d in now}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for version in (now, old):
        for d, (_, component) in brute_components(list(version.items()), 3, 85).items():
            low, high = sorted((root(d), root(component)))
            parent[high] = low
    tags, durable = [], near_dedup.durable
    monkeypatch.setattr(near_dedup, "durable", lambda df, tag, keep=False: (tags.append(tag), durable(df, tag, keep))[1])
    before = spark.createDataFrame([*old.items(), (-1, old[50]), (-2, old[3])], DOCS)  # -1 and -2 are gone already
    got = near_dedup.deduplicated(spark.createDataFrame(list(now.items()), DOCS), 3, 85, before)
    assert sorted(x.doc_id for x in got.collect()) == sorted(d for d in now if root(d) == d)
    assert {50, 51} <= {d for d in now if root(d) == d}
    assert len(tags) == len(set(tags))


def test_odd_sketches_estimate_high_similarities():
    r = random.Random(3)
    words = [f"w{r.random()}" for _ in range(600)]
    for share in (0.95, 0.9, 0.8):
        a, b = " ".join(words[:500]), " ".join(words[: int(500 * share)])
        hashes, cuts = near_dedup.shingle_sets(pa.array([a, b]), 1)
        sketches = near_dedup.signatures(hashes, cuts)[3]
        differing = bin(int.from_bytes(sketches[0].tobytes()) ^ int.from_bytes(sketches[1].tobytes())).count("1")
        assert abs(near_dedup.estimated_similarity(differing) - share) < 0.1


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    got = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(edges, schema)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.connected_components(spark.createDataFrame([], schema)).count() == 0


def test_components_need_no_round_to_see_that_they_are_done(spark, monkeypatch):
    """Stars are components as they are; a round that changes nothing is a dozen shuffles for nothing."""
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, tag, keep=False, f=graph.durable: written.append(tag) or f(df, tag, keep))
    stars = [(1, i) for i in range(2, 9)] + [(i, 10) for i in range(11, 15)] + [(3, 1)]
    for edges, rounds in ((stars, 0), ([*stars, (2, 10)], 1)):
        written.clear()
        got = {x.id: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == dict.fromkeys(range(1, 9), 1) | dict.fromkeys(range(10, 15), 10 if not rounds else 1)
        assert written.count("stars") <= rounds * 2
