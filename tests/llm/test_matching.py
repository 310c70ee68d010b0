"""Decontamination, BPE, URL filters, nearest neighbours and licences against brute force or public libraries."""

import random
import re
import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from scriptorium.llm import ann, bpe, decontaminate, license_scan, url_filter

# --- greedy string tiling


def slow_tiles(a, b, least):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return tiles
        k, i, j = best
        tiles.append((i, j, k))
        free_a[i : i + k] = free_b[j : j + k] = [False] * k


@pytest.mark.parametrize("seed", range(5))
def test_tiling_like_brute_force(seed):
    r = random.Random(seed)
    for _ in range(40):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(0, 30))] for _ in range(2))
        tiles = decontaminate.tile(a, b, 3)
        assert tiles == slow_tiles(a, b, 3)


def test_tiling_of_repetitive_words_is_fast():
    r = random.Random(1)
    text = [x for _ in range(360) for x in [1] * r.randint(5, 14) + [2]]
    began = time.time()
    tiles = decontaminate.tile([1] * 600, text)
    assert time.time() - began < 0.5
    assert sum(n for _, _, n in tiles) > 590


def test_every_leak_of_the_tables_like_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "benchmark"))
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", license_scan.ascii_lower(t or ""))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = [(r.doc_id, words(r.text)) for r in docs.collect()]
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = set()
    for doc, text in texts:
        for item, own in items:
            if len(own) >= 5 and runs(own) & runs(text):
                matched = sum(n for _, _, n in slow_tiles(own, text, 5))
                if 2 * matched >= len(own):
                    want.add((doc, item, len(own), matched))
    got = {(x.doc_id, x.item_id, x.item_words, x.matched_words) for x in decontaminate.op5_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and want


def test_leaks_are_found_even_if_reordered(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:40])
    moved = " ".join(words[20:40]) + " other things " + " ".join(words[:20])
    docs = [(1, "Intro. " + item.upper() + " end"), (2, moved), (3, " ".join(words[:12]) + " unrelated text"), (4, None), (5, ""), (1, item), (None, item), (6, "x " * 40_000 + item)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item)], "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert sorted((x.doc_id or 0, x.item_id) for x in got) == [(0, 7), (1, 7), (1, 7), (2, 7), (6, 7)]
    assert {x.doc_id: len(x.tiles) for x in got}[2] == 2
    left = decontaminate.decontaminate(frame, bench)
    assert left.columns == frame.columns and sorted(x.doc_id for x in left.collect()) == [3, 4, 5]
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_hot_passages_and_seeds_that_the_bitmap_admits_wrongly(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(f"v{r.randint(0, 10**6)}" for _ in range(20)) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"head {t} tail") for i, t in enumerate(texts)] + [(100 + i, f"n{i} {texts[3]} m{i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = {(i, i) for i in range(12)} | {(100 + i, 3) for i in range(300)}
    for bits in (26, 7):
        monkeypatch.setattr(decontaminate, "BITS", bits)
        assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()} == want
    assert decontaminate.decontaminate(docs, bench).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(*bpe.default_tokenizer())


def test_encoding_like_tiktoken(coder):
    own = tiktoken.Encoding("own", pat_str=bpe.default_tokenizer()[1], mergeable_ranks=coder.vocabulary.ranks, special_tokens={})
    r = random.Random(1)
    letters = "abcd  \n\t\x1c\x85\xa0 éßñ0123½²!?#'srevll日本語🙂aaaaTh"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert coder.encode(text) == own.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()
    assert coder.encode(None) == coder.encode("") == []
    assert coder.encode("a" * 20_000) == own.encode_ordinary("a" * 20_000)


def test_appends_and_edits_like_fresh_tables(coder):
    r, v = random.Random(2), coder.vocabulary
    for _ in range(300):
        text = bytes(r.choice(b"abcdeth in\xc3\xa9") for _ in range(r.randint(0, 400)))
        grown = bpe.PrefixTable(v, text[: len(text) // 2])
        grown.append(text[len(text) // 2 :])
        assert grown.last == bpe.PrefixTable(v, text).last
        assert grown.ids() == v.merge(text)
        at = r.randint(0, len(text))
        end, new = min(len(text), at + r.randint(0, 4)), bytes(r.choice(b"abth") for _ in range(r.randint(0, 4)))
        grown.edit(at, end, new)
        assert grown.last == bpe.PrefixTable(v, text[:at] + new + text[end:]).last
    table = bpe.PrefixTable(v, b"the thing is " * 2000)
    assert table.edit(100, 101, b"x") < 400  # far from all 26,000 entries


def test_each_byte_takes_one_step_and_what_is_in_use_stays_known(coder, monkeypatch):
    """An entry asks for one step and little more than one token, however many tokens end there; a full memory keeps what is used."""
    own = tiktoken.Encoding("own", pat_str=bpe.default_tokenizer()[1], mergeable_ranks=coder.vocabulary.ranks, special_tokens={})
    taken = []
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe.Encoder, "_piece", lambda self, piece, f=bpe.Encoder._piece: taken.append(piece) or f(self, piece))
    fresh = bpe.Encoder(coder.vocabulary, bpe.default_tokenizer()[1])
    r = random.Random(8)
    for _ in range(400):
        text = "so common, " + "".join(r.choice("abcdeth") for _ in range(9)) + " common," + "".join(r.choice("ab, th\n'") for _ in range(20)) + " common"
        assert fresh.encode(text) == own.encode_ordinary(text)
    assert taken.count(" common") <= 2
    v = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"a" * n: 254 + n for n in range(2, 40)})
    assert [v.shorter[254 + n] for n in (2, 3, 39)] == [97, 256, 292]
    assert v.longest_at[v.step(v.step(0, 97), 97)] == 256 and len(v.states) == 3


def test_encoding_of_tables(spark, coder):
    rows = [(1, "Hello there", 1), (1, "Hello there", 1), (2, None, 1), (None, "", 1), (3, "x" * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.bpe_encode(docs).collect()
    assert sorted((x.doc_id or 0, len(x.ids)) for x in got) == sorted((d or 0, len(coder.encode(t))) for d, t, _ in rows)
    assert next(x.ids for x in got if x.doc_id == 1) == coder.encode("Hello there")
    assert bpe.bpe_digests(docs).count() == 5 and bpe.bpe_encode(docs.limit(0)).count() == 0


# --- URL filters


def slow_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_like_brute_force(spark):
    r = random.Random(6)
    rules = url_filter.RULES + [("block", "a.b.com", "/"), ("allow", "b.com", "/x/y"), ("block", "b.com", "/x/y/z"), ("allow", "com", "")]
    hosts = ["a.b.com", "b.com", "xb.com", "www.A.b.com", "example.com", "q.example.com", "example.net", "org", "", "com.", ".com", "例え.com", "user@b.com:80"]
    urls = [f"{r.choice(['http://', 'https://', '', '://'])}{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/7', '/en/71', '/x/y', '/x/y/z1', '/de/8', '/es/1'])}{r.choice(['', '?a=/en/', '#f', '?x#y'])}" for _ in range(400)] + [None, "", "no scheme"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.url_verdicts(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: slow_verdict(u, rules) for i, u in enumerate(urls)}


def test_the_rules_are_those_of_the_contract(spark, tmp_path):
    """Each rule with its word: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    wanted = [("a.com/en/1", "com/en/", "block"), ("example.com/en/71", "example.com/en/7", "allow"), ("a.net/de/1", "net/de/", "allow"), ("example.net/de/1", "net/de/", "allow"), ("www.example.net/de/80", "example.net/de/8", "block"), ("a.org/es/", "org/es/", "block"), ("a.org/de/", None, "allow")]
    spark.createDataFrame([(i, f"https://{u}") for i, (u, _, _) in enumerate(wanted)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(wanted)}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [(x.rule, x.verdict) for x in url_filter.url_verdicts(pages, none).collect()] == [(None, "allow")] * 2
    assert url_filter.url_verdicts(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    twice = url_filter.rule_table(spark, [("block", "a.com", "/en/"), ("allow", "a.com", "/en/"), (None, None, None)])
    assert [x.verdict for x in url_filter.url_verdicts(pages, twice).collect()] == ["allow"] * 2


def test_openings_that_many_items_and_documents_share_make_no_pairs(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    opening = "once upon a time there lived a"
    items = [(k, opening + " " + " ".join(word() for _ in range(20))) for k in range(300)]
    docs = [(k, opening + " " + " ".join(word() for _ in range(20))) for k in range(3000)] + [(5000 + k, "see " + items[k][1].split(" ", 3)[3]) for k in range(20)]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    seeds = decontaminate.seed_table(decontaminate.item_table(bench))
    found = decontaminate._hits(frame, decontaminate.bitmap(seeds), decontaminate.LEAST).withColumn("doc", F.col("doc_id"))
    hits = decontaminate.durable(found, "test-hits")
    assert hits.count() == 3020
    assert decontaminate.candidates(hits, seeds).count() == 20
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame, bench).collect()} == {(5000 + k, k) for k in range(20)}


def test_rare_seeds_leave_out_what_cannot_cover_enough():
    r = random.Random(12)
    for _ in range(300):
        size = r.randint(5, 40)
        starts = r.sample(range(size - 4), r.randint(1, size - 4))
        seeds, k = [], 0
        while starts:
            some, starts = starts[: r.randint(1, 2)], starts[r.randint(1, 2) :]
            seeds.append({"n": r.randint(1, 4), "seed": k, "starts": some})
            k += 1
        rare = decontaminate.rare_seeds(size, seeds, 0.5)
        of = lambda some: len({p + d for x in some for p in x["starts"] for d in range(5)})
        assert of([x for x in seeds if x["seed"] not in rare]) < 0.5 * size
        assert (not rare) == (of(seeds) < 0.5 * size)


# --- nearest neighbours


def slow_neighbours(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = []
    for q in (i for i in good if i % every == 0):
        near = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q)[:k]
        out += [(q, rank + 1, i, round(s, 9)) for rank, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_like_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(600)]
    rows += [(700, rows[0][1]), (800, [0.0] * 8), (900, None), (1000, [1.0] * 7 + [None]), (1001, [float("nan")] + [1.0] * 7), (1002, [float("inf")] + [1.0] * 7), (1003, [1.0] * 5), (None, [1.0] * 8), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = sorted((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in ann.search(frame).collect())
    assert got == slow_neighbours(rows, 100, 10)


@pytest.mark.parametrize(("offset", "kind"), [(0.0, "double"), (1e4, "double"), (1e8, "double"), (3e11, "double"), (0.0, "float"), (1e4, "float")])
def test_neighbours_wherever_the_vectors_lie(spark, offset, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 16)) + offset * r.choice([-1.0, 1.0], size=16)
    x[1900:] += 50 * max(1.0, offset / 1e3)  # a second cloud far from the mean
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = sorted((n.query_id, n.rank, n.vec_id, n.score) for n in ann.search(frame).collect())
    want = []
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        want += [(q, k + 1, int(i), float(d[i])) for k, i in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    got = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0])], schema)).collect()
    assert sorted((x.rank, x.vec_id, x.score) for x in got) == [(1, 1, 0.0), (2, 2, 0.0)]


def test_beam_search_beats_greedy_coding():
    x = np.random.default_rng(1).normal(size=(500, 16))
    q = ann.Quantiser(x, books=4, words=16)
    x = x - q.shift
    off = lambda codes: float(((x - q.decode(codes)) ** 2).sum())
    assert off(q.encode(x, 8)) < off(q.encode(x, 1)) < float((x**2).sum())


# --- licences


def test_licences(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.",
        2: "Under the GNU General Public License, version 3, or any later version. MIT License too.",
        3: "CC-BY-NC-SA 4.0 and cc by",
        4: "SPDX-License-Identifier: BSD-3-Clause",
        5: "A success story about accepting limits.",
        6: None,
        7: "",
        8: "word " * 60_000 + "mit license",
    }
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").withColumn("labels", F.lit(1))
    rows = license_scan.license_scan(docs).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == 9
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word) == ("apache,apache-2.0", "apache", 1, 3)
    assert got[2].base_labels == "gpl,mit" and "gpl-3.0-or-later" in got[2].labels.split(",") and "gpl-3.0" not in got[2].labels.split(",")
    assert got[3].labels == "cc-by,cc-by-nc-sa-4.0" and got[3].n_base == 2
    assert got[4].labels == "bsd-3-clause" and got[4].n_base == 0 and got[4].first_word is None
    assert all((got[i].labels, got[i].score, got[i].n_base) == ("", 0.0, 0) for i in (5, 6, 7))
    assert (got[8].n_words, got[8].first_word, got[8].last_word) == (60_002, 60_000, 60_000)
    assert license_scan.license_scan(docs.limit(0)).count() == 0
    assert len(license_scan.rules()) > 200


def test_suppression_like_brute_force():
    r = random.Random(4)
    for _ in range(200):
        found = [license_scan.Detection(s := r.randint(0, 20), s + r.randint(1, 8), "x", r.randint(0, 5), 1.0) for _ in range(12)]
        kept = []
        for d in sorted(found, key=lambda d: (d.order, d.start - d.end, d.start)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert sorted(map(repr, license_scan.suppress(found))) == sorted(map(repr, kept))


def test_base_columns_like_sql(spark):
    import duckdb

    texts = ["MIT License and the GNU General Public License", "cc by, CC-BY; cc by-sa", None, "", "apache license apache license", "the gnu general public licenses", "élan mit license " * 3, "x " * 50_000 + "mit\nlicense"]
    rows = list(enumerate(texts))
    got = license_scan.base_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels FROM ({license_scan.BASE_ORACLE})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(x.n_base for x in got) > 8


def test_texts_are_not_cut_for_other_patterns():
    path, pattern = bpe.default_tokenizer()
    other = bpe.encoder(path, r"[a-z]+ [a-z]+|.")
    assert not other.cuts_at_blanks and other.decode(other.encode("ab cd ef")) == b"ab cd ef"
    assert other.encode("ab cd") == bpe.PrefixTable(other.vocabulary, b"ab cd").ids()
    usual = bpe.encoder(path, pattern)
    long = "ab" * 5_000 + "c" * 3_000
    assert usual.decode(usual.encode(long)) == long.encode()
