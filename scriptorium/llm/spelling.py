"""Spelling variants: words of a corpus one edit apart, by a self-join of the vocabulary's trie with active-node sets.

Each node of a trie has a set of active nodes: those whose strings are within the bound of its own.  A child's set comes
from its parent's, so going down the trie once finds for every word all words within the bound.  With a bound of one the
set of a node is the node itself, with the edit still to come, and nodes at distance one, below which only equal
characters may follow.

The trie is dealt out by prefixes.  Two words one edit apart, the shorter of m characters, either begin with the same
half (the edit comes later) or end with the same (it came before).  So each word goes to four groups: of m its own length
and one less, the first half or the last.  A group of more words than one task should take is divided again: with the
part where the edit may be halved, its words share more characters, until one character is left, where the alphabet bounds
a group.  No pair is lost: the first place where two words differ lies in exactly one part, and only there the pair counts.

Words are counted in one pass over the texts that keeps a batch's counts, so a frequent word leaves a task once a batch.

Defined results: null texts have no words, a null ``doc_id`` reads as empty in the misspelling rule; repeated rows count
each time; texts without letters and empty tables give no rows; other columns are not read.  A word's form is its most
frequent near word, the first in code-point order of equally frequent ones, and null unless frequent enough.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, slices, table, text_bytes, tune

#: Code points and occurrences that a word has at least; how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words that one task takes as a group; groups of words that share all but one character are at most the alphabet's square.
GROUP_WORDS = 20_000
RUN = re.compile("[a-zÀ-ÿ]+")
#: Of the runs of a document, those whose crc32 this divides lose a character.
MISSPELT = 199


def damaged(run: str, prefix: int) -> str:
    """The run, without one code point if the rule says so; ``prefix`` is the crc32 of the id and colon before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word and n (occurrences in whole texts) of all words of ``least_length`` code points and more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                raw, found = data.tobytes(), Counter()
                for at, stop, key in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("doc_id").to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                    # bytes.lower() lowers A-Z alone
                    for run, n in Counter(RUN.findall(raw[at:stop].lower().decode("utf-8", "replace"))).items():
                        if len(run) >= least_length:
                            word = damaged(run, prefix)
                            if len(word) >= least_length:
                                found[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the trie --------------------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("children", "words")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.words: list[tuple[str, int]] = []  # words whose piece ends here, with their counts


def trie(pieces: Iterable[tuple[str, str, int]]) -> Node:
    root = Node()
    for piece, word, n in pieces:
        node = root
        for c in piece:
            child = node.children.get(c)
            if child is None:
                child = node.children[c] = Node()
            node = child
        node.words.append((word, n))
    return root


def near_pairs(root: Node) -> Iterator[tuple[int, tuple[str, int], tuple[str, int]]]:
    """Each two of the trie's words whose pieces are one edit apart, once, with the length of what the pieces begin with alike.

    Goes down the trie with each node's active nodes: itself, and the nodes at distance one, each with the depth at which
    the two parted.  A node's set is made from its parent's: the children of active nodes under the same character remain
    active, and from the node itself a replaced or an inserted character opens new ones.  Of two nodes that are active for
    one another only one keeps the other: of siblings the former, else the shorter.
    """
    stack: list[tuple[Node, int, list[tuple[Node, int]]]] = [(root, 0, [])]
    while stack:
        node, depth, active = stack.pop()
        for word in node.words:
            for other, parted in active:
                for near in other.words:
                    yield parted, word, near
        below = list(node.children.items())
        for i, (c, child) in enumerate(below):
            found = [(deeper, parted) for other, parted in active if (deeper := other.children.get(c)) is not None]
            found += [(sibling, depth) for _, sibling in below[i + 1 :]]  # replaced
            for d, sibling in below:  # the other side has one character, d, more
                if d != c and (longer := sibling.children.get(c)) is not None:
                    found.append((longer, depth))
            stack.append((child, depth + 1, found))
        # A word may end where a longer one goes on by one character.
        for word in node.words:
            for child in node.children.values():
                for near in child.words:
                    yield depth, word, near


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words both ways, from rows that come ordered by group."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("m", "low", "high", "shared", "word", "n")), strict=True)

    def out(found: list[tuple]) -> pa.RecordBatch:
        word, near, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "n"])

    found: list[tuple] = []
    for (m, low, high, _), group in groupby(rows(), key=lambda r: r[:4]):
        pieces = [(word[low : len(word) - (m - high)], word, n) for *_, word, n in group]
        if len(pieces) < 2:
            continue
        for parted, (a, n_a), (b, n_b) in near_pairs(trie(pieces)):
            # Two of m + 1 characters meet in the next group of lengths, and a place behind this part in the next part.
            if min(len(a), len(b)) == m and (low + parted < high or high == m):
                found += [(a, b, n_b), (b, a, n_a)]
        if len(found) >= 20_000:
            yield out(found)
            found = []
    yield out(found)


def _shared(word: Column, m: Column, low: Column, high: Column) -> Column:
    """What the words of a group have in common: all before and all behind the part where the edit may be."""
    return F.concat(F.substring(word, F.lit(1), low), F.lit(" "), F.substring(word, F.length(word) - (m - high) + 1, m - high))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the former and with the latter half of its part."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    halves = rows.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.low", "p.high")
    return halves.withColumn("shared", _shared(F.col("word"), F.col("m"), F.col("low"), F.col("high")))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, near and n (of ``near``) for all ordered pairs of ``words`` (word, n; each word once) exactly one edit apart."""
    group = ["m", "low", "high", "shared"]
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", lengths).where("m > 0").select("*", F.lit(0).alias("low"), F.col("m").alias("high"))
    rows, ready = _halved(rows), []
    while True:
        rows = durable(rows, "spelling-groups")
        large = rows.groupBy(*group).agg(F.count("*").alias("size")).where((F.col("size") > group_words) & (F.col("high") - F.col("low") > 1))
        large = durable(large.select(*group), "spelling-large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, group, "left_anti"))
        rows = _halved(rows.join(large, group, "left_semi"))
    found = None
    for part in ready:
        near = part.repartition(*group).sortWithinPartitions(*group).mapInArrow(_joined, "word string, near string, n long")
        found = near if found is None else found.unionByName(near)
    return found


# --- forms and roots -------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word and root for the words of ``forms`` (word, form; no form null): where following forms ends.

    Forms are ``TIMES`` as frequent as their words, so a chain is short, and each round doubles the steps that are taken.
    """
    at = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        moved = durable(at.join(ahead, "root", "left").select("word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts with ``least_count`` occurrences and more."""
    words = durable(word_counts(docs).where(F.col("n") >= least_count), "spelling-words")
    near = near_words(words, group_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = durable(formed, "spelling-forms")
    found = formed.join(roots(formed.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 byte by byte from its polynomial; near words share what is left without one character.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256)))
, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL)
, counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL)
, hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted)
, bytes AS (SELECT run, n, list_transform(range(1, length(h) + 1, 2), lambda k: (strpos('0123456789ABCDEF', h[k]) - 1) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 1) AS b FROM hexed)
, hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table)
, spelt AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
, words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5)
, without AS MATERIALIZED (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words))
, pairs AS (
  SELECT a.word, b.word AS near, b.n FROM without a JOIN without b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word)
, best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word)
, firsts AS (SELECT b.word, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.most GROUP BY b.word)
, formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN firsts f ON f.word = w.word)
, chains AS (
  SELECT word, word AS at, form AS ahead FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.ahead)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.ahead IS NULL
"""
