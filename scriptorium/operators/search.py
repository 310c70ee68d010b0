"""Searches of a stated query set against all rows: parts of the rows meet blocks of the queries, one join for all of them.

Items (texts to search for) make inverted indexes of blocks of bounded size, which add up scores in numpy; vectors meet
their queries likewise.  No row leaves a task but what may be among a query's nearest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import durable, small

#: Items and rows, or queries and rows, that meet in a task; bits, as a power of two, of the bitmap of terms.
BLOCK_ITEMS, PART_ROWS, BLOCK_QUERIES, BITS = 4096, 16_384, 1024, 24


def best_rows(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Positions of the ``k`` best of each key: by rounded score, then by id."""
    order = np.lexsort((ids, -np.round(scores, digits), keys))
    sorted_keys = keys[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_keys, sorted_keys)
    return order[place < k]


def term_bits(terms: DataFrame) -> bytes:
    """A bitmap of fixed size of the terms' crc32: what it does not have is no term."""
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << BITS))
    rows = terms.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return words.astype("<i8").tobytes()


def matched(docs: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """doc_id, size (tokens), kinds (different ones), and the ``terms`` that may be asked for with how often each occurs.

    The one pass over the texts: tokens are found once, and of a text only what is asked for goes on.  Rows without an id
    take no part; null texts have no tokens.
    """
    shared, find = docs.sparkSession.sparkContext.broadcast(term_bits(terms)), re.compile(pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("kinds", pa.int64()), ("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value, (1 << BITS) - 1
        for batch in batches:
            sizes, kinds, found, tf = [], [], [], []
            for text in batch.column("text").to_pylist():
                counts = Counter(find.findall((text or "").lower()))
                sizes.append(sum(counts.values()))
                kinds.append(len(counts))
                hits = [t for t in counts if bits[(c := crc32(t.encode()) & mask) >> 3] >> (c & 7) & 1]
                found.append(hits)
                tf.append([counts[t] for t in hits])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip((sizes, kinds, found, tf), list(schema)[1:], strict=True))], schema=schema)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(rows.mapInArrow(work, "doc_id long, size long, kinds long, terms array<string>, tf array<int>"), "matched-terms")


class Block:
    """Items as an inverted index: for each term the items that hold it, with the term's weight."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: pa.Array, weights: np.ndarray):
        self.ids, self.sizes = ids, np.asarray(sizes, np.float64)
        coded = terms.dictionary_encode()
        self.terms, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(numbers, kind="stable")
        self.items = np.repeat(np.arange(len(ids)), sizes)[order]
        self.starts = np.searchsorted(numbers[order], np.arange(len(self.terms) + 1))
        self.weights = np.zeros(len(self.terms))
        self.weights[numbers] = weights

    def scores(self, docs: np.ndarray, n_docs: int, terms: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and score of every pair that shares a term, from documents' terms (by number) and their worth."""
        fan = self.starts[terms + 1] - self.starts[terms]
        within = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        cells = np.repeat(docs, fan) * len(self.ids) + self.items[np.repeat(self.starts[terms], fan) + within]
        total = np.bincount(cells, np.repeat(worth * self.weights[terms], fan), n_docs * len(self.ids))
        found = np.unique(cells)
        return found // len(self.ids), found % len(self.ids), total[found]


def _lexical(k: int, digits: int, bm25: bool, mean_size: float):
    """A cogrouped function: documents' terms and items of one part and block to the part's best documents of each item."""

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if rows.num_rows and asked.num_rows:
            held = asked["terms"].combine_chunks()
            block = Block(asked["item_id"].to_numpy(), held.value_lengths().to_numpy(), held.flatten(), asked["weights"].combine_chunks().flatten().to_numpy())
            step = max(1, (1 << 21) // max(1, len(block.ids)))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                terms, tf = part["terms"].combine_chunks(), part["tf"].combine_chunks().flatten().to_numpy().astype(np.float64)
                of = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                numbers = pc.fill_null(pc.index_in(terms.flatten(), value_set=block.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero(numbers >= 0)
                numbers, of, tf = numbers[hit], of[hit], tf[hit]
                sizes = part["size"].to_numpy()
                worth = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sizes[of] / mean_size)) if bm25 else np.ones(len(tf))
                docs, items, score = block.scores(of, part.num_rows, numbers, worth)
                if not bm25:
                    score = 2 * score / (part["kinds"].to_numpy()[docs] + block.sizes[items])
                kept = [np.concatenate(x) for x in zip(kept, (items, score, part["doc_id"].to_numpy()[docs]), strict=True)]
                best = best_rows(kept[0], kept[1], kept[2], k, digits)
                kept = [x[best] for x in kept]
            kept[0] = block.ids[kept[0]]
        return pa.table({"item_id": pa.array(kept[0], pa.int64()), "doc_id": pa.array(kept[2], pa.int64()), "score": pa.array(kept[1], pa.float64())})

    return work


def terms_of(items: DataFrame, pattern: str) -> DataFrame:
    return items.select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("terms")).where(F.size("terms") > 0)


def top_documents(docs: DataFrame, items: DataFrame, pattern: str, k: int, digits: int, bm25: bool) -> DataFrame:
    """item_id, doc_id and score of the best of each part; the caller ranks them.

    Texts are tokenised once.  Documents are dealt into parts and items into blocks of bounded size, and each part meets
    each block in a join; of a document only the terms that items ask for are shuffled.  The score is BM25, or the F1 of
    the sets of terms.
    """
    asked = terms_of(items, pattern)
    each = asked.select("item_id", F.explode("terms").alias("term"))
    rows = matched(docs, each.select("term").distinct(), pattern)
    n_docs, total, mean = rows.agg(F.count("*"), F.count_if(F.col("size") > 0), F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(1.0))).first()
    if bm25:
        df = rows.select(F.explode("terms").alias("term")).join(small(each.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
        weight = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        each = each.join(df.select("term", weight.alias("weight")), "term")
    else:
        each = each.withColumn("weight", F.lit(1.0))
    held = each.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))  # an item's terms
    held = durable(held.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "asked-terms")
    parts, blocks = max(1, -(-n_docs // PART_ROWS)), max(1, -(-held.count() // BLOCK_ITEMS))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.where(F.size("terms") > 0).select("*", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), every_of(blocks).alias("block"))
    right = held.select("*", every_of(parts).alias("part"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_lexical(k, digits, bm25, mean), "item_id long, doc_id long, score double")


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, vec_id and cosine of the ``k`` best rows of each query in each part of the rows.

    ``queries``: query_id, q.  Zero vectors have no cosine and are left out.  Rows are dealt into parts and queries into
    blocks, and each part meets each block once.
    """

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            x, q = _matrix(rows, "embedding"), _matrix(asked, "q")
            ids, own = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            parts = []
            for at in range(0, len(q), 64):
                s = slice(at, at + 64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = q[s] @ x.T / (norm_q[s][:, None] * norm_x)
                score[(own[s][:, None] == ids) | ~np.isfinite(score)] = -np.inf
                edge = np.round(np.partition(score, -k, axis=1)[:, -k] if len(x) > k else np.full(len(score), -2.0), digits)
                a, b = np.nonzero((np.round(score, digits) >= edge[:, None]) & (score > -np.inf))
                best = best_rows(a, score[a, b], ids[b], k, digits)
                parts.append((own[s][a[best]], ids[b[best]], score[a[best], b[best]]))
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(out[0]), "vec_id": pa.array(out[1]), "score": pa.array(out[2])})

    parts, blocks = max(1, -(-vectors.count() // PART_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), every_of(blocks).alias("block"))
    right = queries.select("query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
