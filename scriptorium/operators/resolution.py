"""Names of one kind that mean the same: a similarity join, then the election of leaders in order of confidence.

Two names are the same if they are equal once titles and suffixes are gone, if one is an initial form or the last word of
the other, or if their Jaro-Winkler similarity reaches a bound.  Each name, surest first, joins the first leader that is
the same as it, or else becomes a leader.

Names are decided in batches by rank, each four times as large as all before: the leaders of a batch come from the pairs
within it, and every name further down that is the same as one of them follows at once and is out.  So no name is held
against another that follows a leader already, and what leaves a task grows with the names and not with their pairs.

Candidates meet by keys that lose no pair.  With three equal characters to begin with, that is the key.  With two at the
most, the bound demands so many shared characters that, for any two lengths, both names have two of them among their
rarest few; the keys are the two lengths and those two characters.  Groups of more names than a task should take are
dealt into parts that meet pairwise, so no task holds more than two parts, and only confirmed pairs leave a task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import durable, scratch, table
from . import kernels
from .ordering import placed

# Titles and suffixes that do not tell names apart.
TITLES = r"(?i)^(Dr|Mr|Mrs|Ms|Miss|Prof|Rev|Hon|Sgt|Cpl|Pvt|Capt|Lt|Col|Gen|Cmdr|Adm)\.\s*"
PERSON_SUFFIXES = r"(?i),?\s+(Jr\.?|Sr\.?|III|IV|II|Esq\.?|Ph\.?D\.?|M\.?D\.?)$"
ORG_SUFFIXES = r"(?i),?\s+(Inc\.?|LLC|Ltd\.?|Corp\.?|Co\.?|PLC|LP|LLP|GmbH|AG|SA|NV|Pty\.?|S\.?A\.?)$"
LEAST = 0.85
#: Names of a group that one task holds at once.
PART_NAMES = 4096
#: Names of a label in the first batch; characters of a name that is compared with others than its equals.
FIRST_BATCH, LONGEST = 512, 120
NAME = r"(?:[A-Z][a-z]{2,}|\b[A-Z]\.?) [A-Z][a-z]{2,}"
#: Letters from the most frequent on; only how well keys divide depends on it.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz."


def person(name: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(F.regexp_replace(strip(name), TITLES, "")), PERSON_SUFFIXES, "")))


def organisation(name: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(name), ORG_SUFFIXES, "")))


def keys_of(name: str, least: float) -> set[str]:
    """Keys of which two names that are the same have at least one in common; none for what is too long for a name."""
    if len(name) > LONGEST:
        return set()
    found = {f"begin {name[:3]}"} if len(name) > 2 else set()
    parts = name.split()
    if len(parts) > 1:
        found |= {f"initial {parts[-1]} {parts[0][0]}", f"last {parts[-1]}"}
    elif parts:
        found.add(f"last {parts[0]}")
    seen: Counter = Counter()
    tokens = []
    for c in name:
        seen[c] += 1
        tokens.append((-seen[c], -_FREQUENT.find(c) if c in _FREQUENT else -99, c))
    tokens.sort()
    size = len(name)
    # Of Jaro-Winkler with two equal characters at the beginning: shared / size + shared / other >= share.
    share = 3 * (least - 0.2) / 0.8 - 1
    for other in range(max(1, math.ceil(size * (share - 1) - 1e-9)), min(LONGEST, math.floor(size / (share - 1) + 1e-9)) + 1):
        shared = math.ceil(share * size * other / (size + other) - 1e-9)
        if shared > min(size, other):
            continue
        width = min(2, shared)
        lengths = f"{min(size, other)} {max(size, other)}"
        for some in combinations(tokens[: size - shared + width], width):
            found.add(" ".join((lengths, *(f"{c}{-k}" for k, _, c in some))))
    return found


def _with_keys(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [sorted(keys_of(name, least)) for name in part.column("name").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns), pa.array([k for some in keys for k in some], pa.string())], [*part.schema.names, "key"])

    return work


def _letters(names: list[str]) -> np.ndarray:
    """Characters of each name, counted in 32 classes: what two names share in these bounds what they share."""
    out = np.zeros((len(names), 32), np.int16)
    for k, name in enumerate(names):
        for c in name:
            out[k, ord(c) & 31] += 1
    return out


class Names:
    """Names with what bounds their similarity, one against many."""

    def __init__(self, names: list[str]):
        self.names, self.counts, self.sizes = names, _letters(names), np.array([len(x) for x in names], np.float64)
        self.starts = np.array([[ord(c) for c in x[:4].ljust(4, "\0")] for x in names], np.int64).reshape(len(names), 4)
        self.last = np.array([zlib.crc32(x.split()[-1].encode()) if x.split() else 0 for x in names], np.int64)

    def likely(self, other: Names, i: int, least: float) -> np.ndarray:
        """Positions of names that may be the same as the other's i-th."""
        shared = np.minimum(self.counts, other.counts[i]).sum(axis=1)
        jaro = (shared / self.sizes + shared / other.sizes[i] + 1) / 3
        begin = np.cumprod((self.starts == other.starts[i]) & (other.starts[i] > 0), axis=1).sum(axis=1)
        return np.flatnonzero((jaro + begin * 0.1 * (1 - jaro) >= least - 1e-9) | (self.last == other.last[i]))


def same_pairs(names: list[str], parts: list[int], least: float) -> Iterator[tuple[int, int]]:
    """Positions of each two of the names that are the same; with two parts, only those between them."""
    held, across = Names(names), len(set(parts)) > 1
    for i in range(len(names)):
        for j in held.likely(held, i, least).tolist():
            if j > i and (not across or parts[i] != parts[j]) and kernels.same_name(names[i], names[j], least):
                yield i, j


def _grouped(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come ordered by their first ``keys`` fields, a group at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in fields), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


def _out(found: list[tuple], fields: list[str]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], fields)


def _pairs(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for (label, _, cell), members in _grouped(batches, ("label", "key", "cell", "part", "name", "confidence"), 3):
            first, _, second = cell.partition(" ")
            parts = [m[0] for m in members]
            if first != second and len(set(parts)) < 2:
                continue
            for i, j in same_pairs([m[1] for m in members], parts, least):
                (_, a, x), (_, b, y) = members[i], members[j]
                found.append((label, b, a) if (-x, a) < (-y, b) else (label, a, b))
            if len(found) >= 20_000:
                yield _out(found, ["label", "name", "earlier"])
                found = []
        yield _out(found, ["label", "name", "earlier"])

    return work


def _keyed(names: DataFrame, least: float) -> DataFrame:
    return durable(names.mapInArrow(_with_keys(least), "label string, name string, confidence double, key string"), "name-keys")


def _within(keyed: DataFrame, least: float, part_names: int) -> DataFrame:
    sizes = keyed.groupBy("label", "key").agg(F.count("*").alias("size")).where("size > 1")
    n = F.ceil(F.col("size") / part_names)
    dealt = keyed.join(sizes, ["label", "key"]).select("label", "key", "name", "confidence", F.pmod(F.xxhash64("name"), n).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    cells = dealt.withColumn("cell", F.concat_ws(" ", F.least("part", "other"), F.greatest("part", "other")))
    group = ["label", "key", "cell"]
    found = cells.select(*group, "part", "name", "confidence").repartition(*group).sortWithinPartitions(*group)
    return found.mapInArrow(_pairs(least), "label string, name string, earlier string").distinct()


def same_names(names: DataFrame, least: float = LEAST, part_names: int = PART_NAMES) -> DataFrame:
    """label, name, earlier: each two of the ``names`` (label, name, confidence; distinct) that are the same, the surer one as ``earlier``."""
    return _within(_keyed(names, least), least, part_names)


def _firsts(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for (label, _, _), members in _grouped(batches, ("label", "key", "cell", "leads", "name", "confidence"), 3):
            leads = [n for _, _, n in sorted((-c, n, n) for is_lead, n, c in members if is_lead)]
            others = [n for is_lead, n, _ in members if not is_lead]
            if not leads or not others:
                continue
            held, asked = Names(leads), Names(others)
            for i, name in enumerate(others):
                first = next((leads[j] for j in held.likely(asked, i, least).tolist() if kernels.same_name(name, leads[j], least)), None)
                if first is not None:
                    found.append((label, name, first))
            if len(found) >= 20_000:
                yield _out(found, ["label", "name", "leader"])
                found = []
        yield _out(found, ["label", "name", "leader"])

    return work


def _following(leading: DataFrame, others: DataFrame, least: float, part_names: int) -> DataFrame:
    """label, name, leader: the first of the ``leading`` (both sides with keys) that each of the others is the same as."""
    sizes = leading.groupBy("label", "key").agg(F.count("*").alias("nl")).join(others.groupBy("label", "key").agg(F.count("*").alias("no")), ["label", "key"])
    sizes = sizes.select("label", "key", F.ceil(F.col("nl") / part_names).alias("pl"), F.ceil(F.col("no") / part_names).alias("po"))
    every, own = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)), lambda n: F.pmod(F.xxhash64("name"), n)
    cell = F.concat_ws(" ", "x", "y").alias("cell")
    a = leading.join(sizes, ["label", "key"]).select("label", "key", "name", "confidence", own(F.col("pl")).alias("x"), every(F.col("po")).alias("y")).select("label", "key", cell, F.lit(True).alias("leads"), "name", "confidence")
    b = others.join(sizes, ["label", "key"]).select("label", "key", "name", "confidence", own(F.col("po")).alias("y"), every(F.col("pl")).alias("x")).select("label", "key", cell, F.lit(False).alias("leads"), "name", "confidence")
    group = ["label", "key", "cell"]
    found = a.unionByName(b).repartition(*group).sortWithinPartitions(*group).mapInArrow(_firsts(least), "label string, name string, leader string")
    ranks = leading.select("label", F.col("name").alias("leader"), (-F.col("confidence")).alias("less")).distinct()
    return found.distinct().join(ranks, ["label", "leader"]).groupBy("label", "name").agg(F.min(F.struct("less", "leader")).alias("best")).select("label", "name", "best.leader")


def leaders(same: DataFrame) -> DataFrame:
    """label and name of those names that lead, of all that ``same`` (label, name, earlier) has.

    In rounds: whoever waits for no earlier name leads; whoever is the same as a leader follows, and both are out.  The
    earliest name of all is decided in each round, so rounds end; a chain of names that each wait for the one before takes
    a round for every second one.
    """
    at = ["label", "name"]
    as_earlier = lambda rows: rows.withColumnRenamed("name", "earlier")
    waits = durable(same.select(*at, "earlier"), "names-waits")
    left = durable(waits.select(*at).union(waits.select("label", "earlier")).distinct(), "names-left")
    chosen = None
    while True:
        leading = durable(left.join(waits, at, "left_anti"), "names-leading")
        chosen = leading if chosen is None else chosen.unionByName(leading)
        following = durable(waits.join(as_earlier(leading), ["label", "earlier"], "left_semi").select(*at).distinct(), "names-following")
        left = durable(left.join(leading, at, "left_anti").join(following, at, "left_anti"), "names-left")
        if left.isEmpty():
            return chosen
        waits = durable(waits.join(following, at, "left_anti").join(as_earlier(following), ["label", "earlier"], "left_anti").select(*at, "earlier"), "names-waits")


def led(names: DataFrame, least: float = LEAST, part_names: int = PART_NAMES, first_batch: int = FIRST_BATCH) -> DataFrame:
    """label, name, leader of those of the ``names`` (label, name, confidence; distinct) that follow another."""
    if least <= 0.7:
        raise ValueError("the keys need a bound over 0.7")
    at = ["label", "name"]
    places = placed(names.withColumn("less", -F.col("confidence")), ["label"], ["less", "name"])
    batch = F.greatest(F.lit(0), F.ceil(F.log(F.col("place") / first_batch) / F.log(F.lit(4.0)))).cast("int")
    ranked = durable(places.select("label", "name", "confidence", batch.alias("batch")), "names-ranked")
    last = ranked.agg(F.max("batch")).first()[0]
    left, found = ranked, None
    for number in range(-1 if last is None else last + 1):
        keyed = durable(left.mapInArrow(_with_keys(least), "label string, name string, confidence double, batch int, key string"), "names-keyed")
        mine = keyed.where(F.col("batch") == number).drop("batch")
        same = durable(_within(mine, least, part_names), "names-same")
        waiting = same.select(*at).union(same.select("label", F.col("earlier").alias("name"))).distinct()
        leading = durable(left.where(F.col("batch") == number).select(*at).join(waiting, at, "left_anti").unionByName(leaders(same)), "names-leaders")
        ahead = mine.join(leading, at, "left_semi")
        rest = keyed.where(F.col("batch") >= number).drop("batch").join(leading, at, "left_anti")
        fresh = durable(_following(ahead, rest, least, part_names), "names-found", keep=True)
        found = fresh if found is None else found.unionByName(fresh)
        left = durable(left.where(F.col("batch") > number).join(fresh, at, "left_anti"), "names-left")
    return found if found is not None else ranked.select(*at, F.col("name").alias("leader")).limit(0)


def resolved(entities: DataFrame, clean=person, least: float = LEAST, part_names: int = PART_NAMES, first_batch: int = FIRST_BATCH) -> DataFrame:
    """label, name, leader of every distinct name of ``entities`` (label, name, confidence).

    Defined results: a name's confidence is its largest, ties go to the smaller cleaned name; null labels are a label, null names
    no name; names of which cleaning leaves nothing are compared as they are; names of more than ``LONGEST`` characters are
    the same as equal ones only; no names, no rows.
    """
    surfaces = entities.where("name is not null").groupBy("label", "name").agg(F.max("confidence").cast("double").alias("confidence"))
    surfaces = surfaces.withColumn("label", F.coalesce("label", F.lit("\x00"))).withColumn("clean", clean(F.col("name")))
    with scratch(entities.sparkSession):
        surfaces = durable(surfaces.withColumn("clean", F.when(F.col("clean") == "", F.col("name")).otherwise(F.col("clean"))), "names", keep=True)
        best = F.min(F.struct((-F.col("confidence")).alias("less"), "name")).alias("best")
        names = surfaces.groupBy("label", "clean").agg(best).select("label", F.col("clean").alias("name"), (-F.col("best.less")).alias("confidence"), F.col("best.name").alias("surface"))
        names = durable(names, "names-clean", keep=True)
        found = led(names.select("label", "name", "confidence"), least, part_names, first_batch)
        shown = names.select("label", F.col("name").alias("leader"), F.col("surface").alias("shown"))
        found = durable(found.join(shown, ["label", "leader"]).select("label", "name", "shown"), "names-led", keep=True)
    own = names.join(found, ["label", "name"], "left").select("label", F.col("name").alias("clean"), F.coalesce("shown", "surface").alias("leader"))
    out = surfaces.join(own, ["label", "clean"])
    return out.select(F.when(F.col("label") != "\x00", F.col("label")).alias("label"), "name", "leader")


def resolved_names(docs: DataFrame) -> DataFrame:
    """Names in the texts (two capitalised words, or an initial and one) of each language, by how often they occur."""
    found = docs.select(F.col("lang").alias("label"), F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name"))
    return resolved(found.groupBy("label", "name").agg(F.count("*").alias("confidence")))


_SQL = r"""
WITH found AS (SELECT lang AS label, unnest(regexp_extract_all(text, '(?:[A-Z][a-z]{2,}|\b[A-Z]\.?) [A-Z][a-z]{2,}')) AS name FROM documents),
surfaces AS (
  SELECT label, name, count(*) AS n,
    lower(regexp_replace(regexp_replace(name, '^(Dr|Mr|Mrs|Ms|Miss|Prof|Rev|Hon|Sgt|Cpl|Pvt|Capt|Lt|Col|Gen|Cmdr|Adm)\.\s*', '', 'i'), ',?\s+(Jr\.?|Sr\.?|III|IV|II|Esq\.?|Ph\.?D\.?|M\.?D\.?)$', '', 'i')) AS clean
  FROM found GROUP BY ALL),
names AS (SELECT label, clean, max(n) AS n, min_by(name, (-n, name)) AS surface FROM surfaces GROUP BY label, clean),
listed AS (SELECT label, list({'c': clean, 's': surface, 'p': string_split_regex(clean, '\s+')} ORDER BY n DESC, clean) AS l FROM names GROUP BY label),
led AS (
  SELECT label, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: SAME)) > 0 THEN acc ELSE acc || x END) AS leaders
  FROM listed),
each AS (SELECT label, unnest(list_transform(l, lambda x: [x])) AS x FROM listed)
SELECT s.label, s.name, (list_filter(d.leaders, lambda y: SAME)[1]).s AS leader
FROM each e JOIN led d ON d.label IS NOT DISTINCT FROM e.label JOIN surfaces s ON s.label IS NOT DISTINCT FROM e.label AND s.clean = e.x[1].c
"""
_SAME = r"""(y.c = x[1].c OR jaro_winkler_similarity(y.c, x[1].c) >= 0.85
  OR (y.p[-1] = x[1].p[-1] AND ((len(y.p) = 1) <> (len(x[1].p) = 1)
    OR (len(y.p) > 1 AND len(x[1].p) > 1 AND ((length(rtrim(y.p[1], '.')) = 1 AND starts_with(x[1].p[1], rtrim(y.p[1], '.'))) OR (length(rtrim(x[1].p[1], '.')) = 1 AND starts_with(y.p[1], rtrim(x[1].p[1], '.'))))))))"""


def queries() -> dict[str, tuple]:
    return {"resolved_names": (lambda spark, d: resolved_names(table(spark, d, "documents")), _SQL.replace("SAME", _SAME))}
