"""Spelling variants: the trie against all pairs, the whole query against plain Python and SQL."""

import itertools
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(deadline=None, max_examples=150)
@given(st.sets(st.text("abé", max_size=7), max_size=25))
def test_trie_finds_each_near_pair_once(words):
    found = [(tuple(sorted((a[0], b[0]))), p) for p, a, b in S.near_pairs(S.trie((w, w, 1) for w in words))]
    assert sorted(p for p, _ in found) == sorted(p for p in itertools.combinations(sorted(words), 2) if near(*p))
    for (a, b), parted in found:
        assert parted == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_groups_divided_or_not_find_the_same_pairs(spark):
    words = sorted({"".join(w) for n in (1, 2, 6, 7) for w in itertools.islice(itertools.product("abc", repeat=n), 0, 400, 3)} | {"prefix" + "".join(w) for w in itertools.product("xy", repeat=5)})
    frame = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    want = sorted((a, b, len(b)) for a, b in itertools.permutations(words, 2) if near(a, b))
    for most in (10, 20_000):
        assert sorted(map(tuple, S.near_words(frame, most).collect())) == want, most


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    of = {w: [v for v in words if v != w and near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in of.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(of[w]), words[form[w]] if w in form else None))
    return sorted(out)


def test_whole_texts_ties_chains_and_odd_rows(spark):
    rows = [(1, "banana " * 160), (2, "banan " * 3 + "bananas " * 26 + "bananass\n" * 6), (3, None), (4, ""), (None, "Bananas, " * 4 + "ÄPFELN ÄPFELN" * 3)]
    rows += [(5, "window " * 30 + "widow " * 30 + "winndow winddow " * 6), (5, "window " * 2), (6, "12 !! " * 9), (7, "Äpfeln äpfeln " * 40 + "Apfeln " * 5 + "winter " * 25 + "winder " * 25 + "winfer " * 5)]
    rows += [(k, "the committee accepted several committees and acceptance of committe " * 3) for k in range(400, 700)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, word string")
    found = sorted(map(tuple, S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert found == plain(rows)
    assert any(r[1] for r in found) and any(r[1] and r[2] != r[1] for r in found)
    assert S.variants(docs.limit(0)).count() == 0


def test_the_query_equals_plain_python_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    found = sorted(map(tuple, S.op11_spelling(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert found == plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(S.ORACLE).fetchall()) == found
