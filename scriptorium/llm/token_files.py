"""Token ids in binary files of fixed-width bit packing, with random access.

A file is a shard of the corpus in ascending order of ``doc_id``: a header, a table of its documents, a table of block
offsets with checksums, and the ids, each in as many bits as the vocabulary needs.  64 ids fill ``width`` whole 64-bit
words, so a block starts on a byte, and packing or unpacking is 64 shifts over numpy columns.  The layout (little-endian)::

    magic 8s | width u32 | block_ids u32 | n_ids u64 | n_docs u64 | part u64 | start u64
    doc_id i64[n_docs] | has_id u8[n_docs] | first u64[n_docs + 1] | offset u64[n_blocks + 1] | crc u32[n_blocks] | payload

``part`` is the range of documents that the shard belongs to and ``start`` the number of ids before it in that part, so
places in the whole corpus need one sum a part.  Spark's own file writer writes the shards (a row each), so they appear
in any store that Spark writes to, and only once their task has committed; a byte that ends the row follows the payload.

Texts are encoded blank by blank: this tokenizer's pieces never cross ASCII blanks, so each distinct stretch between them
is given to the tokenizers library once in a worker's memory and looked up from then on.

Defined results: a null or empty text is the end id alone; every row is a document, repeated ids included (ordered by a
hash of the text, equal texts being alike); rows with a null id come first; no documents make no files and no rows; other
columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from .common import durable, slices, table, tune

MAGIC = b"IDBITS01"
HEADER = struct.Struct("<8sIIQQQQ")
#: Ids in a shard (or one document, if that has more) and in a block; stretches that a worker remembers.
SHARD_IDS, BLOCK_IDS, CACHE_STRETCHES = 1 << 23, 4096, 600_000
END_ID = 2
# Characters that the tokenizer's normal form leaves alone but for case (printable ASCII, Latin letters),
# how it divides them once lowered, and the characters that its vocabulary has for bytes.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")
NOT_PLAIN, SET_APART = r"[^\t-\r!-~À-ÖØ-öø-įı-ſ ]|<\|", r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+)"
_UNSEEN = [b for b in range(256) if b <= 32 or 127 <= b <= 160 or b == 173]
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(_UNSEEN)}


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """The ids as 64-bit words, ``width`` bits each; the last group of 64 is filled up with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.T)
    words = np.zeros((width, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(-1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The ids of ``pack``, those that fill up the last group included."""
    groups = len(words) // width
    columns = np.ascontiguousarray(words.reshape(groups, width).T)
    lanes, mask = np.empty((64, groups), np.uint32), np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= columns[word + 1] << np.uint64(64 - shift)
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)


def shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, width: int, part: int, start: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One file's bytes."""
    if block_ids % 64:
        raise ValueError("a block must hold a multiple of 64 ids")
    payload = pack(ids, width).tobytes()
    step = block_ids * width // 8
    offsets = np.append(np.arange(0, len(payload), step, np.uint64), np.uint64(len(payload)))
    crcs = np.array([zlib.crc32(payload[at : at + step]) for at in range(0, len(payload), step)], np.uint32)
    first = np.zeros(len(counts) + 1, np.uint64)
    np.cumsum(counts, out=first[1:], dtype=np.uint64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    head = HEADER.pack(MAGIC, width, block_ids, len(ids), len(doc_ids), part, start)
    return b"".join([head, keys.tobytes(), has.tobytes(), first.tobytes(), offsets.tobytes(), crcs.tobytes(), payload])


class Shard:
    """Random access to one file, given whole (bytes) or as an open, seekable file: only the blocks asked for are read."""

    def __init__(self, source):
        self._source = source
        magic, self.width, self.block_ids, self.n_ids, self.n_docs, self.part, self.start = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        n_blocks = -(-self.n_ids // self.block_ids)

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            at += size
            return np.frombuffer(self._read(at - size, size), kind)

        keys, has = take(np.int64, self.n_docs), take(np.uint8, self.n_docs)
        self.doc_ids = [int(k) if h else None for k, h in zip(keys, has, strict=True)]
        self.first = take(np.uint64, self.n_docs + 1).astype(np.int64)
        self._offsets, self._crcs, self._payload = take(np.uint64, n_blocks + 1).astype(np.int64), take(np.uint32, n_blocks), at

    def _read(self, at: int, size: int) -> bytes:
        if isinstance(self._source, (bytes, memoryview)):
            found = self._source[at : at + size]
        else:
            self._source.seek(at)
            found = self._source.read(size)
        if len(found) != size:
            raise ValueError("the file ends too early")
        return found

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` (exclusive) of this file."""
        if not 0 <= low <= high <= self.n_ids:
            raise IndexError((low, high))
        if low == high:
            return np.zeros(0, np.uint32)
        one, last = low // self.block_ids, (high - 1) // self.block_ids
        at = self._offsets[one]
        raw = self._read(self._payload + at, self._offsets[last + 1] - at)
        for block in range(one, last + 1):
            if zlib.crc32(raw[self._offsets[block] - at : self._offsets[block + 1] - at]) != self._crcs[block]:
                raise ValueError(f"block {block} is damaged")
        return unpack(np.frombuffer(raw, np.uint64), self.width)[low - one * self.block_ids : high - one * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document, its end id included."""
        return self.ids(self.first[k], self.first[k + 1])


# --- encoding --------------------------------------------------------------------------------------------------------


class StretchEncoder:
    """Ids of whole texts, from those of the stretches between ASCII blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._place: dict[str, int] = {}
        self._ends, self._flat, self._uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop all stretches that only one slice had: rare words come and go, frequent ones stay."""
        kept = [(s, k) for s, k in self._place.items() if self._uses[k] > 1] if self._place else []
        places = np.array([k for _, k in kept], np.int64)
        sizes = (self._ends[1:] - self._ends[:-1])[places] if len(kept) else np.zeros(0, np.int64)
        ends = np.zeros(len(kept) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        self._flat = self._flat[np.repeat(self._ends[places] - ends[:-1], sizes) + np.arange(ends[-1])]
        self._ends, self._uses = ends, np.zeros(len(kept), np.int64)
        self._place = {s: k for k, (s, _) in enumerate(kept)} if 2 * len(kept) < CACHE_STRETCHES else {}
        if not self._place:
            self._ends, self._flat, self._uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _spelt(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch, as bytes.

        Of plain characters the pieces go to the library's model; everything else to all of the library.
        """
        out, others, tokenize = [b""] * len(stretches), [], self._model.tokenize
        for k, stretch in enumerate(stretches):
            if stretch.isascii() and stretch.isalpha():
                out[k] = array("I", [t.id for t in tokenize(stretch.lower())]).tobytes()
            elif PLAIN.fullmatch(stretch) and "<|" not in stretch:
                spelt = (piece.encode().decode("latin-1").translate(BYTE_CHARACTERS) for piece in PIECE.findall(stretch.lower()))
                out[k] = array("I", [t.id for piece in spelt for t in tokenize(piece)]).tobytes()
            else:
                others.append(k)
        for k, encoding in zip(others, self._tokenizer.encode_batch([stretches[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = array("I", encoding.ids).tobytes()
        return out

    def _places(self, stretches: list[str]) -> np.ndarray:
        if len(self._place) + len(stretches) > CACHE_STRETCHES:
            self._forget()
        known = self._place
        fresh = [s for s in stretches if s not in known]
        if fresh:
            found = self._spelt(fresh)
            ends = np.cumsum([len(ids) for ids in found], dtype=np.int64) // 4 + self._ends[-1]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self._ends = np.concatenate([self._ends, ends])
            self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(found), np.uint32)])
            self._uses = np.concatenate([self._uses, np.zeros(len(fresh), np.int64)])
        places = np.array([known[s] for s in stretches], np.int64)
        self._uses[places] += 1
        return places

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, ``end_id`` behind each text, and the number of each text's ids."""
        texts = texts.fill_null("")
        # Texts of plain characters are divided further, into lowered pieces, of which far fewer differ.
        plain = pc.invert(pc.match_substring_regex(texts, NOT_PLAIN))
        texts = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(texts), SET_APART, r" \1 "), texts)
        pieces = pc.ascii_split_whitespace(texts)
        words = pieces.flatten().dictionary_encode()
        places = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        sizes = (self._ends[1:] - self._ends[:-1])[places]
        total = np.zeros(len(places) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = self._flat[np.repeat(self._ends[places] - total[:-1], sizes) + np.arange(total[-1])]
        of_text = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), out=of_text[1:])
        counts = total[of_text[1:]] - total[of_text[:-1]]
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        return out, counts + 1


_encoders: dict[str, StretchEncoder] = {}


def encoder(path: str) -> StretchEncoder:
    """One encoder a worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = StretchEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- writing and reading ---------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents below ``path`` (which must not exist), in ascending order of ``doc_id``."""
    place = tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(place)
        width = width_for(max(coder.vocabulary, end_id + 1))
        part, written = TaskContext.get().partitionId(), 0
        keys, counts, ids, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            raw = shard(keys, np.concatenate(counts), np.concatenate(ids), width, part, written, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["file"])

        for batch in batches:
            for some in slices(batch):
                more, sizes = coder.encode(some.column("text"), end_id)
                if held and held + len(more) > shard_ids:
                    yield row()
                    written += held
                    keys, counts, ids, held = [], [], [], 0
                keys += some.column("doc_id").to_pylist()
                counts.append(sizes)
                ids.append(more)
                held += len(more)
        if held:
            yield row()

    tune(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = ordered.select("doc_id", "text").mapInArrow(work, "file binary")
    # The text writer puts out a row's bytes as they are: a file a row.
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _per_document(spark: SparkSession, path: str, column: str, kind: str, of) -> DataFrame:
    """part, start (in its part), doc_id, n_tokens and ``column`` of every document in the files; ``of`` makes the latter from ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                file = Shard(memoryview(raw.as_buffer()))
                for at in range(0, file.n_docs, 1000):
                    yield _rows(file, at, min(at + 1000, file.n_docs))

    def _rows(file: Shard, at: int, stop: int) -> pa.RecordBatch:
        ids = file.ids(file.first[at], file.first[stop])
        bounds = file.first[at : stop + 1] - file.first[at]
        made = [of(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [pa.array(np.full(stop - at, file.part, np.int64)), pa.array(file.first[at:stop] + file.start), pa.array(file.doc_ids[at:stop], pa.int64()), pa.array(np.diff(bounds))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.int64() if kind == "long" else pa.list_(pa.int32()))], ["part", "start", "doc_id", "n_tokens", column])

    tune(spark)
    return _shards(spark, path).mapInArrow(work, f"part long, start long, doc_id long, n_tokens long, {column} {kind}")


def _placed(rows: DataFrame) -> DataFrame:
    """``start`` counted from the first document of all: the parts (as many as tasks that wrote) are summed up on the driver."""
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, sums = 0, []
    for part in sorted(sizes):
        sums.append((part, before))
        before += sizes[part]
    bases = rows.sparkSession.createDataFrame(sums, "part long, base long")
    others = [c for c in rows.columns if c not in ("part", "start", "doc_id")]
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), *others)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ``ids array<int>`` of every document in the files below ``path``."""
    return _placed(_per_document(spark, path, "ids", "array<int>", lambda ids: ids.astype(np.int32)))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids (as little-endian 32-bit integers), from the files."""
    found = durable(_per_document(spark, path, "ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes())), "token-digests")
    return _placed(found)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/scriptorium/token-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
