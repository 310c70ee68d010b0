"""Nearest neighbours by additive quantisation, with exact re-ranking.

A vector is written as a sum of full-dimensional codewords, one of each codebook.  Codebooks are fitted one after the
other to what the former left over and then refined together by least squares; a beam search finds each vector's codes.
The index keeps, beside the vector, its codes, the squared norm of the sum they stand for and the distance between the
two.

A query makes one table of inner products with all codewords; the distance to a coded vector is then a few look-ups and
the stored norm.  By the triangle inequality the true distance lies within the stored distance of it, so whatever cannot
be among the nearest is left out, and what remains is ranked by exact distances.  Results are therefore exact.

Coding and bounding take vectors less the mean of those that were fitted, which leaves distances as they are; sums that
may cancel get a slack by the norms of what goes into them, so rounding rules nothing out wherever the vectors lie.

The search is one join.  Index rows lie in cells, one for each word of the first codebook, and each cell has a centre and
a radius.  A query begins with a bound, the distance of the last of its nearest among the vectors that the codebooks were
fitted on, and goes only to the cells that reach within it.  Cells are dealt into parts and their queries into blocks of
bounded size; rows and queries meet by cell, part and block, and no row beyond a query's bound leaves a task.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as query nor as candidate; ties go to the smaller id; a query's own id is never a candidate, while equal
vectors under other ids are; repeated ids count once; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import durable, table, tune
from .sampling import bounded

#: Codebooks, codewords in each, vectors they are fitted on, beams kept; about so many rows and queries meet in a task at once.
BOOKS, WORDS, FIT_ROWS, BEAMS, PART_ROWS, BLOCK_QUERIES = 6, 64, 8192, 4, 8192, 2048
#: Query and row pairs whose approximate distances are held at once.
PAIRS = 1 << 17
NEAREST = 10


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)


def _cluster(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = x[rng.choice(len(x), count, replace=len(x) < count)].copy()
    for _ in range(rounds):
        own = nearest_words(x, words)
        sums, sizes = np.zeros_like(words), np.bincount(own, minlength=count)
        np.add.at(sums, own, x)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[rng.integers(0, len(x), count)])
    return words


def rounding(width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far |a|**2 + |b|**2 - 2 ab may be from the squared distance, by the norms of both sides."""
    return 1e-15 * (width + 16) * (a + b) ** 2


class Quantiser:
    """Codebooks for vectors less ``shift``; every method takes or gives such."""

    def __init__(self, x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11):
        self.shift = x.mean(axis=0)
        x = x - self.shift
        rng = np.random.default_rng(seed)
        rest, found = x.astype(np.float64), []
        for _ in range(books):
            found.append(_cluster(rest, words, rng))
            rest = rest - found[-1][nearest_words(rest, found[-1])]
        self.books = np.array(found)
        for _ in range(2):  # all codebooks together, given the codes
            codes = self.encode(x)
            picks = np.zeros((len(x), books * words))
            picks[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
            solved = np.linalg.solve(picks.T @ picks + 1e-3 * np.eye(books * words), picks.T @ x + 1e-3 * self.books.reshape(books * words, -1))
            self.books = solved.reshape(self.books.shape)

    def encode(self, x: np.ndarray, beams: int = BEAMS) -> np.ndarray:
        """Codes by beam search: after each codebook the ``beams`` sums nearest to the vector go on."""
        n, width = x.shape
        rest, codes, errors = x[:, None, :].astype(np.float64), np.zeros((n, 1, 0), np.int64), (x**2).sum(axis=1)[:, None]
        for words in self.books:
            step = errors[:, :, None] + (words**2).sum(axis=1) - 2 * (rest.reshape(-1, width) @ words.T).reshape(n, -1, len(words))
            flat = step.reshape(n, -1)
            keep = np.argpartition(flat, min(beams, flat.shape[1]) - 1, axis=1)[:, :beams]
            beam, word = keep // len(words), keep % len(words)
            rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None]], axis=2)
            errors = np.take_along_axis(flat, keep, axis=1)
        return codes[np.arange(n), errors.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes].sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner product of each query with each codeword: queries x books x words."""
        return np.einsum("qd,bwd->qbw", queries, self.books)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def build(rows: DataFrame, width: int) -> tuple[Quantiser, np.ndarray, np.ndarray, DataFrame]:
    """The quantiser, the ids and vectors (about FIT_ROWS) it was fitted on, and the index of all rows:
    id, v, codes, norm, off, cell, and ``reach``, the distance from the cell's centre."""
    sample = bounded(rows, "id", FIT_ROWS).toArrow()
    if not sample.num_rows:  # few rows, and the hash spared none of them
        sample = rows.orderBy("id").limit(FIT_ROWS).toArrow()
    order = np.argsort(sample["id"].to_numpy(), kind="stable")
    ids, fitted = sample["id"].to_numpy()[order], _matrix(sample["v"].combine_chunks(), width)[order]
    quantiser = Quantiser(fitted)
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part.column("v"), width) - q.shift
                codes = q.encode(x)
                near = q.decode(codes)
                flat = pa.array(codes.astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]), flat)
                cells = codes[:, 0].astype(np.int32)
                norms, tiny = (near**2).sum(axis=1), 1e-14 * (np.abs(q.books[np.arange(len(q.books)), codes]).sum(axis=(1, 2)) + np.abs(x).sum(axis=1))
                off, reach = (np.sqrt(((x - c) ** 2).sum(axis=1)) * (1 + 1e-9) + tiny for c in (near, q.books[0][cells]))
                columns = [pa.array(norms), pa.array(off), pa.array(cells), pa.array(reach)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists, *columns], ["id", "v", "codes", "norm", "off", "cell", "reach"])

    index = rows.mapInArrow(work, "id long, v array<double>, codes array<int>, norm double, off double, cell int, reach double")
    return quantiser, ids, fitted, durable(index, "ann-index")


def exact_distances(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - query) ** 2).sum(axis=1))


def _sent(queries: DataFrame, quantiser: Quantiser, ids: np.ndarray, fitted: np.ndarray, radii: np.ndarray, nearest: int) -> DataFrame:
    """id, v, bound and cell: each query once for every cell that reaches within its bound."""
    shared = queries.sparkSession.sparkContext.broadcast((quantiser.books[0], quantiser.shift, ids, fitted - quantiser.shift, radii))
    width = fitted.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, shift, ids, fitted, radii = shared.value
        there, middle = np.linalg.norm(fitted, axis=1), np.linalg.norm(centres, axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, PAIRS // len(fitted))):
                part = batch.slice(at, max(1, PAIRS // len(fitted)))
                q, own = _matrix(part.column("v"), width) - shift, part.column("id").to_numpy()
                here = np.linalg.norm(q, axis=1)[:, None]
                near = here**2 + there**2 - 2 * q @ fitted.T
                near = np.where(own[:, None] == ids, np.inf, np.maximum(near, 0) + rounding(width, here, there))
                bound = np.sqrt(np.partition(near, nearest - 1, axis=1)[:, nearest - 1]) if len(fitted) >= nearest else np.full(len(q), np.inf)
                bound = bound * (1 + 1e-9)
                away = np.sqrt(np.maximum(here**2 + middle**2 - 2 * q @ centres.T - rounding(width, here, middle), 0)) * (1 - 1e-9)
                rows, cells = np.nonzero((away - radii <= bound[:, None]) & (radii >= 0))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), part.column("v").take(pa.array(rows)), pa.array(bound[rows]), pa.array(cells.astype(np.int32))], ["id", "v", "bound", "cell"])

    return queries.select("id", "v").mapInArrow(work, "id long, v array<double>, bound double, cell int")


def _meet(quantiser: Quantiser, width: int, nearest: int):
    """A cogrouped function: rows and queries of one cell, part and block to the block's nearest rows of each query."""

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            x, own = _matrix(rows["v"].combine_chunks(), width), rows["id"].to_numpy()
            codes = _matrix(rows["codes"].combine_chunks(), len(quantiser.books))
            norm, off = rows["norm"].to_numpy(), rows["off"].to_numpy()
            there = np.linalg.norm(quantiser.books, axis=2)[np.arange(codes.shape[1]), codes].sum(axis=1)
            q, ids, bound = _matrix(asked["v"].combine_chunks(), width), asked["id"].to_numpy(), asked["bound"].to_numpy()
            parts = []
            for at in range(0, len(q), max(1, PAIRS // len(x))):
                block = slice(at, at + max(1, PAIRS // len(x)))
                centred = q[block] - quantiser.shift
                tables, here = quantiser.tables(centred), np.linalg.norm(centred, axis=1)[:, None]
                inner = sum(tables[:, b][:, codes[:, b]] for b in range(codes.shape[1]))
                about, doubt = np.sqrt(np.maximum(here**2 + norm - 2 * inner, 0)), rounding(width, here, there)
                slack = off + 1e-9 * about + np.minimum(np.sqrt(doubt), doubt / np.maximum(about, 1e-300))
                others = ids[block][:, None] != own
                limit = bound[block]
                if len(x) > nearest:
                    limit = np.minimum(limit, np.partition(np.where(others, about + slack, np.inf), nearest - 1, axis=1)[:, nearest - 1])
                hit_q, hit_x = np.nonzero((about - slack <= limit[:, None]) & others)
                score = exact_distances(q[block][hit_q], x[hit_x])
                order = np.lexsort((own[hit_x], score, hit_q))
                hit_q, hit_x, score = hit_q[order], hit_x[order], score[order]
                place = np.arange(len(hit_q)) - np.searchsorted(hit_q, hit_q)
                keep = place < nearest
                parts.append((ids[block][hit_q[keep]], own[hit_x[keep]], score[keep]))
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(out[0]), "vec_id": pa.array(out[1]), "score": pa.array(out[2])})

    return work


def search(vectors: DataFrame, every: int = 100, nearest: int = NEAREST, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``nearest`` rows of each row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors, key, column)
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths["width"]
    quantiser, ids, fitted, index = build(rows.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v")), width)
    cells = {r["cell"]: r for r in index.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("rows")).collect()}  # one row a codeword
    radii = np.array([cells[c]["radius"] if c in cells else -1.0 for c in range(WORDS)])  # a cell without rows reaches nothing
    asked = durable(_sent(index.where(F.col("id") % every == 0), quantiser, ids, fitted, radii, nearest), "ann-queries")
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    of_cell = lambda counts, size: F.create_map(*(F.lit(x) for c in range(WORDS) for x in (c, max(1, -(-counts(c) // size)))))[F.col("cell")]
    parts, blocks = of_cell(lambda c: cells[c]["rows"] if c in cells else 0, PART_ROWS), of_cell(lambda c: wanted.get(c, 0), BLOCK_QUERIES)
    every_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.select("id", "v", "codes", "norm", "off", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), every_of(blocks).alias("block"))
    right = asked.select("id", "v", "bound", "cell", every_of(parts).alias("part"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    groups = ["cell", "part", "block"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(_meet(quantiser, width, nearest), "query_id long, vec_id long, score double")
    order = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
"""
