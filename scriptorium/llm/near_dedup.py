"""MinHash near-duplicates: bands propose, odd sketches estimate, full shingle sets decide.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit fingerprint of the set, 128
   MinHash samples folded into 32 band keys, and an odd sketch: the samples set bits of a 512-bit map by parity, so that
   the population count of two maps' XOR tells how many samples differ, most precisely for high similarities.
2. Documents with the same set form a class; only one representative of each goes on.
3. In every band bucket all members are held against the smallest one (no pairs within the bucket): odd sketches drop
   what cannot be similar, and the remaining pairs are confirmed on their full sets.
4. Members of a bucket which are still in different components must be compared with each other, so that no link that a
   bucket proposes is lost.  Not all of them: of two sets similar enough, the rarest shingles of each (as many as may be
   missing from the other, and one more) share one, so only documents that share such a shingle meet, and only at
   places early enough in both for what follows to suffice.  In a large group of drifting copies the rarest shingles
   are each copy's own changes, and the group does not multiply.
5. Components are found by star contraction and carried back to all documents.

Two versions of the documents' texts are worked on together: a column ``version`` keeps apart what is compared, while ids,
and so components, are those of the documents.

Two sets of similarity s miss each other in all bands with probability (1 - s**4)**32: 6e-11 at 0.85, 5e-8 at 0.8.

Words are runs without the six ASCII blanks, A-Z lowered.  Defined results: a document with fewer words than a shingle
has one shingle, all its words; null, empty and blank texts have none and are linked with nothing; rows that share a
doc_id are one document, in one component; a null doc_id is linked with nothing and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_BLANK, durable, mix, scratch, shingle_hashes, slices, span_hashes, spans, table, text_bytes, tune
from .graph import connected_components

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: An estimate so far below the threshold rules a pair out; some ten standard deviations.
MARGIN = 0.25
#: Slots, as a power of two, in which shingles are counted to tell rare ones.
RARITY_BITS = 20

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one after the other, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(column)
    lowered = LOWER[data]
    starts, ends, rows = spans(lowered, offsets, NOT_BLANK)
    hashes, owners = shingle_hashes(span_hashes(lowered, starts, ends), rows, len(column), width)
    cuts = np.searchsorted(owners, np.arange(len(column) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints, band keys and odd sketches of non-empty sets that lie one after the other."""
    begins = cuts[:-1]
    prints = [np.add.reduceat(mix(hashes ^ np.uint64(salt)), begins) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    samples = np.empty((len(begins), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        samples[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], begins)
    samples = mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(begins), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + samples[:, r::ROWS] + np.uint64(r))
    places = (samples & np.uint64(SKETCH_BITS - 1)).astype(np.int64) + np.arange(len(begins))[:, None] * SKETCH_BITS
    parity = np.bincount(places.ravel(), minlength=len(begins) * SKETCH_BITS) & 1
    sketches = np.packbits(parity.astype(np.uint8).reshape(len(begins), SKETCH_BITS), axis=1)
    return prints[0], prints[1], keys, sketches


def _lists(values: np.ndarray) -> pa.ListArray:
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    width = len(flat) // max(1, len(values))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), flat)


def signature_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), fp1, fp2, bands, sketch; bands and sketch are empty lists for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, cuts = shingle_sets(part.column("text"), width)
                sizes = np.diff(cuts)
                full = np.flatnonzero(sizes)
                for rows in (full, np.flatnonzero(sizes == 0)):
                    if not len(rows):
                        continue
                    if rows is full:
                        a, b, keys, sketches = signatures(hashes, np.append(cuts[rows], cuts[-1]))
                    else:
                        a = b = np.zeros(len(rows), np.uint64)
                        keys = sketches = np.zeros((len(rows), 0), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(rows)), pa.array(sizes[rows]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(keys), _lists(sketches)],
                        ["doc_id", "n", "fp1", "fp2", "bands", "sketch"],
                    )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, fp1 long, fp2 long, bands array<long>, sketch array<long>")


def estimate_differs(a: Column, b: Column) -> Column:
    """Population count of the XOR of two odd sketches."""
    words = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


def largest_difference(similarity: float) -> int:
    """Bits that may differ for an estimated similarity of at least ``similarity``: each differing sample toggles two."""
    toggled = 2 * SAMPLES * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * toggled / SKETCH_BITS)))


def estimated_similarity(differing: int) -> float:
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing / SKETCH_BITS))


def _version(rows: DataFrame) -> list[str]:
    """The column that tells versions of a document's text apart, if there are any."""
    return [c for c in rows.columns if c == "version"]


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """The pairs a, b whose sketches differ in ``most`` bits at most and whose full sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                (ha, ca), (hb, cb) = shingle_sets(part.column("text_a"), width), shingle_sets(part.column("text_b"), width)
                keep = []
                for i in range(part.num_rows):
                    x, y = ha[ca[i] : ca[i + 1]], hb[cb[i] : cb[i + 1]]
                    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(keep)), part.column("b").take(pa.array(keep))], ["a", "b"])

    version = _version(texts)
    a, b = (texts.select(F.col("doc_id").alias(x), *version, F.col("text").alias(f"text_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(a, ["a", *version]).join(b, ["b", *version]).where(estimate_differs(F.col("sketch_a"), F.col("sketch_b")) <= most)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle in each of 2**RARITY_BITS slots: a table of bounded size, whatever the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                counts += np.bincount(_slots(shingle_sets(part.column("text"), width)[0]), minlength=1 << RARITY_BITS)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["slot", "n"])

    counted = texts.select("doc_id", "text").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << RARITY_BITS, np.int64)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return table


def rare_shingles(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """id, n, ``shingle`` and its ``place`` (from 0), a row for each of a text's rarest shingles, rarest first:
    n - ceil(percent * n / 100) + 1 of them; and the version, if texts have one."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    version = _version(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in slices(batch):
                hashes, cuts = shingle_sets(part.column("text"), width)
                rows, found = [], []
                for i in range(part.num_rows):
                    own = hashes[cuts[i] : cuts[i + 1]]
                    if len(own):
                        most = len(own) - -(-percent * len(own) // 100) + 1
                        found.append(own[np.lexsort((own, counts[_slots(own)]))[:most]])
                        rows.append(i)
                if rows:
                    sizes = [len(x) for x in found]
                    repeat, places = np.repeat(rows, sizes), np.concatenate([np.arange(x, dtype=np.int64) for x in sizes])
                    of = [part.column(c).take(pa.array(repeat)) for c in ("doc_id", *version)]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(np.diff(cuts)[repeat]), pa.array(np.concatenate(found).view(np.int64)), pa.array(places)], ["id", *version, "n", "shingle", "place"])

    kinds = ["id long", *(f"{c} int" for c in version), "n long", "shingle long", "place long"]
    return texts.select("doc_id", *version, "text").mapInArrow(work, ", ".join(kinds))


def _classes(signed: DataFrame) -> DataFrame:
    """The documents with the same set: fp1, fp2, n, their number (``rows``), and the representative with its signature."""
    full, version = signed.where("n > 0 and doc_id is not null"), _version(signed)
    first = F.min(F.struct("doc_id", "bands", "sketch")).alias("first")
    return durable(full.groupBy(*version, "fp1", "fp2", "n").agg(first, F.count("*").alias("rows")).select(*version, "fp1", "fp2", "n", F.col("first.doc_id").alias("rep"), "first.bands", "first.sketch", "rows"), "classes")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row for each row given."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = durable(signature_table(docs, width), "signatures")
    classes = _classes(signed)
    with scratch(docs.sparkSession):
        found = _components(docs, classes, width, percent)
    own = signed.join(classes.where("rows > 1").select("fp1", "fp2", "n", "rep"), ["fp1", "fp2", "n"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = own.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components(docs: DataFrame, classes: DataFrame, width: int, percent: int, equal: DataFrame | None = None) -> DataFrame:
    """id and component of the classes' representatives that are linked to others, and of the ends of ``equal`` (a, b)."""
    version = _version(docs)
    node, bucket = ["id", *version], ["key", *version]
    reps = durable(classes.select(F.col("rep").alias("id"), *version, "bands", "sketch").dropDuplicates(node), "representatives")

    banded = reps.select(*node, F.explode("bands").alias("key"))
    buckets = banded.groupBy(*bucket).agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = durable(banded.join(buckets.select(*bucket, "pivot"), bucket), "members")
    wanted = reps.select(*node, "sketch").join(members.select(*node).distinct(), node, "left_semi")
    texts = durable(docs.withColumnRenamed("doc_id", "id").join(wanted, node).select(F.col("id").alias("doc_id"), *version, "text", "sketch").dropDuplicates(["doc_id", *version]), "candidate-texts")

    most = largest_difference(percent / 100 - MARGIN)
    # A document meets no more pivots than bands, so pairs may be dealt by it at once, for both the distinct and the join.
    stars = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"), *version).repartition("a", *version).distinct()
    links = _confirmed(stars, texts, width, percent, most)
    found = connected_components(durable(links if equal is None else links.unionByName(equal), "links"))

    # What a bucket holds of several components is compared across them, where rare shingles meet.
    labelled = durable(members.select("key", *node).join(found, "id", "left").select("key", *node, F.coalesce("component", "id").alias("component")), "labelled")
    mixed = labelled.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*bucket)
    open_ids = durable(labelled.join(mixed, bucket, "left_semi").select(*node, "component").distinct(), "open")
    open_texts = texts.join(open_ids.withColumnRenamed("id", "doc_id"), ["doc_id", *version], "left_semi")
    rare = durable(rare_shingles(open_texts, rarity(open_texts, width), width, percent).join(open_ids, node), "rare-shingles")
    same = ["shingle", *version]
    meeting = rare.groupBy(*same).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*same)
    meeting = rare.join(meeting, same, "left_semi").join(reps.select(*node, "sketch"), node)
    left, right = (meeting.select(*same, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "place", "component", "sketch"))) for x in "ab")
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (estimate_differs(F.col("sketch_a"), F.col("sketch_b")) <= most)
    # At the rarest shingle two sets share, all that they share stands from there on, in either: it must be enough.
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    across = left.join(right, same).where(apart & enough & alike).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *version).distinct()
    more = durable(_confirmed(across, texts, width, percent, most), "more-links")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    return durable(found, "components", keep=True)


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, before: DataFrame | None = None) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; all columns stay.

    ``before`` may give what the documents' texts were before lines were taken out of them; documents that were
    near-duplicates then are a group as well, as all that is left of a copy may be the lines that tell it apart.
    """
    spark = docs.sparkSession
    if before is None:
        groups = near_duplicates(docs, width, percent).select(F.col("doc_id").alias("id"), F.col("component_id").alias("component"))
    else:
        tune(spark)
        now, then = (x.select("doc_id", "text", F.lit(k).alias("version")) for k, x in enumerate((docs, before)))
        with scratch(spark):
            there = signature_table(then, width).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("version", F.lit(1))
            signed = durable(signature_table(now, width).withColumn("version", F.lit(0)).unionByName(there), "signatures")
            classes = _classes(signed)
            same = ["version", "fp1", "fp2", "n"]
            equal = signed.select("doc_id", *same).join(classes.where("rows > 1").select(*same, "rep"), same).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
            groups = _components(now.unionByName(then), classes, width, percent, equal)
    return docs.join(groups.where("id <> component").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


#: The same from all pairs that share a shingle and are of similar size.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS h, s FROM sets),
reps AS (SELECT min(doc_id) AS rep, h, n, any_value(s) AS s FROM sizes WHERE n > 0 GROUP BY h, n),
grams AS (SELECT rep, n, hash(unnest(s)) AS g FROM reps),
common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, d.n AS n_shingles,
  CASE WHEN d.n = 0 THEN d.doc_id ELSE least(r.rep, coalesce(l.y, r.rep)) END AS component_id,
  d.doc_id = CASE WHEN d.n = 0 THEN d.doc_id ELSE least(r.rep, coalesce(l.y, r.rep)) END AS kept
FROM sizes d LEFT JOIN reps r ON r.h = d.h AND r.n = d.n AND d.n > 0 LEFT JOIN lowest l ON l.x = r.rep
"""
