"""Benchmark decontamination by greedy string tiling.

Seeds (hashes of runs of LEAST words) of documents and benchmark items are joined.  One pass over the documents keeps the
places whose seed a bitmap of the benchmark's seeds admits (a bitmap of fixed size, whatever the benchmark); those
rows meet the benchmark's rare seeds in a join (an item's most frequent seeds, as many as do not cover enough of it, make
no pairs), and pairs whose shared seeds could cover enough of the item are tiled: again and again the longest common run of words that no tile has taken yet is found by running Karp-Rabin hashes and marked.
Tiles need not keep their order, so passages whose parts were moved still add up.  An item is held to be leaked if tiles
cover a share of its words.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lowered.  Defined results: null and empty texts match
nothing; items shorter than LEAST words, and those with a null id, take no part; repeated documents and items each give
their pairs; either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, durable, scratch, shingle_hashes, slices, small, span_hashes, spans, table, text_bytes, tune

#: Words in the shortest tile, and the share of an item's words that tiles must cover.
LEAST, COVERED = 5, 0.5
#: Bits, as a power of two, of the bitmap of the benchmark's seeds.
BITS = 26
_RADIX = np.uint64(0x1F3D5B79A4C68E97)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a text column."""
    data, offsets = text_bytes(column)
    lowered = LOWER[data]
    starts, ends, rows = spans(lowered, offsets, ALNUM)
    return span_hashes(lowered, starts, ends), rows


class Side:
    """One of the two word sequences: its words, which of them are free, and running hashes of its windows."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, np.ones(len(words), bool)
        powers = np.full(len(words) + 1, _RADIX)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        # sums[i] is the hash of the first i words; a window's follows from two of them.
        self.sums = np.zeros(len(words) + 1, np.uint64)
        value = 0
        for i, word in enumerate(words.tolist()):
            value = (value * int(_RADIX) + word) & 0xFFFFFFFFFFFFFFFF
            self.sums[i + 1] = value

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of ``size`` free words."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(taken[size:] == taken[:-size]) if len(self.words) >= size else np.zeros(0, np.int64)
        return starts, self.sums[starts + size] - self.sums[starts] * self.powers[size]


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in text, length) of each tile, longest first.

    Of equal lengths the earliest in the item comes first, with its earliest free place in the text.  The longest length
    is found by halving, as a common window has shorter ones in it; each round takes all tiles of one length, and
    lengths only fall, so that repetitive sequences take few rounds.
    """
    a, b = Side(np.asarray(item, np.uint64)), Side(np.asarray(text, np.uint64))
    tiles, most = [], min(len(a.words), len(b.words))
    while most >= least:
        low, high = least - 1, most  # common windows of ``low`` words exist, unless it is still below ``least``
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(a.windows(size)[1], b.windows(size)[1]).any():
                low = size
            else:
                high = size - 1
        if low < least:
            break
        size = low
        (starts_a, of_a), (starts_b, of_b) = a.windows(size), b.windows(size)
        order = np.argsort(of_b, kind="stable")
        starts_b, of_b = starts_b[order], of_b[order]
        first, end = np.searchsorted(of_b, of_a, "left"), np.searchsorted(of_b, of_a, "right")
        at: dict[int, int] = {}  # how far each window's places in the text are used up
        for start, lo, hi in zip(starts_a.tolist(), first.tolist(), end.tolist(), strict=True):
            if lo == hi or not (a.free[start] and a.free[start + size - 1]):
                continue
            place = at.get(lo, lo)
            while place < hi:
                there = int(starts_b[place])
                place += 1
                # Windows were free when the round began, and its tiles are all of this size: looking at the ends suffices.
                if b.free[there] and b.free[there + size - 1] and (a.words[start : start + size] == b.words[there : there + size]).all():
                    a.free[start : start + size] = b.free[there : there + size] = False
                    tiles.append((start, there, size))
                    break
            at[lo] = place
        most = size - 1
    return tiles


def item_table(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """item (a number of each row), item_id and words of the items that take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, rows = word_hashes(part.column("text"))
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(words.view(np.int64)))
                keep = pa.array(np.diff(cuts) >= least)
                yield pa.RecordBatch.from_arrays([part.column("item_id").filter(keep), lists.filter(keep)], ["item_id", "words"])

    items = benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(work, "item_id long, words array<long>")
    return durable(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def seed_table(items: DataFrame, least: int = LEAST) -> DataFrame:
    """item, size (words), seed and ``starts`` (where the item has it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            words, sizes = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            seeds, rows = shingle_hashes(words, np.repeat(np.arange(len(sizes)), sizes), len(sizes), least)
            starts = np.arange(len(rows)) - np.searchsorted(rows, rows)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows)), pa.array(sizes[rows].astype(np.int64)), pa.array(seeds.view(np.int64)), pa.array(starts.astype(np.int32))], ["item", "size", "seed", "start"])

    seeds = items.select("item", "words").mapInArrow(work, "item long, size long, seed long, start int")
    return durable(seeds.groupBy("item", "size", "seed").agg(F.collect_list("start").alias("starts")), "benchmark-seeds")


def rare_seeds(size: int, seeds: list[dict], covered: float, least: int = LEAST) -> list[int]:
    """The item's seeds less its most frequent ones, as many as do not cover enough of it: who shares those alone cannot leak."""
    inside, ordered = np.zeros(size, bool), sorted(seeds, key=lambda x: (-x["n"], x["seed"]))
    for k, one in enumerate(ordered):
        for start in one["starts"]:
            inside[start : start + least] = True
        if inside.sum() >= covered * size:
            return [x["seed"] for x in ordered[k:]]
    return []


def candidates(hits: DataFrame, seeds: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """doc and item that share one of the item's rare seeds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [(item, seed) for item, size, some in zip(*(batch.column(c).to_pylist() for c in ("item", "size", "seeds")), strict=True) for seed in rare_seeds(size, some, covered, least)]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in chosen], pa.int64()) for k in (0, 1)], ["item", "seed"])

    each = hits.select("doc", F.explode("seeds").alias("seed"))
    counted = each.groupBy("seed").agg(F.count("*").alias("n")).join(small(seeds), "seed")
    by_item = counted.groupBy("item", "size").agg(F.collect_list(F.struct("n", "seed", "starts")).alias("seeds"))  # an item's words at the most
    rare = durable(by_item.mapInArrow(work, "item long, seed long"), "rare-seeds")
    return each.join(small(rare), "seed").select("doc", "item").distinct()


def bitmap(seeds: DataFrame) -> np.ndarray:
    """2**BITS bits, set where the upper bits of a seed say: eight megabytes for a benchmark of any size."""
    slot = F.shiftrightunsigned("seed", 64 - BITS)
    rows = seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


def _hits(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """doc_id, text_hash, seeds, and the words and places (origins) that admitted seeds cover, of documents that have any.

    Runs of covered words are kept apart by a word -1, which matches nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def covered(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + least, -1)
        origins = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        breaks = np.flatnonzero(np.diff(origins) > 1) + 1
        return np.insert(words[origins], breaks, np.uint64(0xFFFFFFFFFFFFFFFF)), np.insert(origins, breaks, -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seeds", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("origins", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch):
                words, rows = word_hashes(part.column("text"))
                seeds, owners = shingle_hashes(words, rows, part.num_rows, least)
                slots = seeds >> np.uint64(64 - BITS)
                hit = np.flatnonzero((bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1))
                firsts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                firsts_of_seeds = np.searchsorted(owners, np.arange(part.num_rows + 1))
                found = []
                for row in np.unique(owners[hit]).tolist():
                    if firsts[row + 1] - firsts[row] < least:
                        continue
                    places = hit[np.searchsorted(hit, firsts_of_seeds[row]) : np.searchsorted(hit, firsts_of_seeds[row + 1])]
                    text, origins = covered(words[firsts[row] : firsts[row + 1]], places - firsts_of_seeds[row])
                    found.append((part.column("doc_id")[row].as_py(), part.column("text_hash")[row].as_py(), np.unique(seeds[places]).view(np.int64), text.view(np.int64), origins.astype(np.int32)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, "doc_id long, text_hash long, seeds array<long>, words array<long>, origins array<int>")


SCHEMA = "doc_id long, text_hash long, item_id long, item_words int, matched_words int, coverage double, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """One row for each document and item that leaked into it; ``text_hash`` tells documents of one id apart."""
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark):
        items = item_table(benchmark, least)
        seeds = seed_table(items, least)
        hits = durable(_hits(docs, bitmap(seeds), least).withColumn("doc", F.monotonically_increasing_id()), "seed-hits")
        pairs = candidates(hits, seeds, covered, least)
        both = pairs.join(hits.select("doc", "doc_id", "text_hash", "seeds", F.col("words").alias("text"), "origins"), "doc")
        both = both.join(small(items.select("item", "item_id", F.col("words").alias("item_text")), 20_000), "item")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row in range(batch.num_rows):
                    one = lambda name: batch.column(name)[row]  # noqa: B023, E731
                    item, text, origins = (one(name).values.to_numpy() for name in ("item_text", "text", "origins"))
                    # Tiles consist of shared seeds, so what those cover bounds them.
                    own, _ = shingle_hashes(item.view(np.uint64), np.zeros(len(item), np.int64), 1, least)
                    starts = np.flatnonzero(np.isin(own.view(np.int64), one("seeds").values.to_numpy()))
                    inside = np.zeros(len(item) + 1, np.int64)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, starts + least, -1)
                    if (np.cumsum(inside) > 0).sum() < covered * len(item):
                        continue
                    tiles = tile(item.view(np.uint64), text.view(np.uint64), least)
                    matched = sum(n for _, _, n in tiles)
                    if matched >= covered * len(item):
                        spans_of = [{"item_start": a, "doc_start": int(origins[b]), "words": n} for a, b, n in tiles]
                        found.append((one("doc_id").as_py(), one("text_hash").as_py(), one("item_id").as_py(), len(item), matched, matched / len(item), spans_of))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], ["doc_id", "text_hash", "item_id", "item_words", "matched_words", "coverage", "tiles"])

        rows = both.select("doc_id", "text_hash", "item_id", "seeds", "text", "origins", "item_text").mapInArrow(work, SCHEMA)
        return durable(rows, "leaks", keep=True)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))]


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, item_words, matched_words, coverage and tiles of each document and item that leaked into it."""
    return leaks(docs, benchmark, covered, least).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """The documents, with all their columns, into which no item leaked."""
    gone = leaks(docs, benchmark, covered, least).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    return docs.join(small(gone), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_text")), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
