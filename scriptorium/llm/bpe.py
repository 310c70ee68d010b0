"""Byte-level BPE by prefix dynamic programming, with appends, edits and decoding.

A token sequence is what BPE gives exactly when each two neighbours are: merging the bytes of the two from scratch must
give the two again.  So every prefix of a piece has one valid last token, and the table of those last tokens is the whole
encoding: walking back from any prefix spells its ids.  Appending fills further entries without touching old ones; an
edit keeps the entries before it and stops as soon as the entries behind it repeat the old ones.

Defined results: a null or empty text has no tokens; any bytes can be encoded, as all 256 single bytes are tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tune

#: Pieces whose ids a worker remembers; at the bound those go that were not asked for since it was last reached.
CACHE_PIECES = 150_000
CACHE_PAIRS = 300_000
#: Pieces that begin with the same bytes grow from one table of them.
HEAD, CACHE_HEADS = 6, 60_000


class Vocabulary:
    """Ranks of a byte-level BPE, read from lines of base64 token and rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        # An automaton over texts: a state is the longest end of what was read that begins a token, and knows the longest
        # token that ends there. Steps (of a state and a byte) are worked out when they are first taken.
        self.begins = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.states, self.state_of, self.longest_at, self.steps = [b""], {b"": 0}, [-1], {}
        # The next shorter token at a token's end.
        self.shorter = [self._end_token(token, 1) if token else -1 for token in self.bytes_of]
        self.size_of = list(map(len, self.bytes_of))
        # The two tokens whose merge makes each longer one.
        self.halves = [tuple(self.merge(t, 2)) if len(t) > 1 else None for t in self.bytes_of]
        self._pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def _end_token(self, text: bytes, start: int = 0) -> int:
        """The longest token that is an end of ``text[start:]``, or -1."""
        return next((rank for at in range(start, len(text)) if (rank := self.ranks.get(text[at:])) is not None), -1)

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; there are no more states than beginnings of tokens."""
        text = self.states[state] + bytes([byte])
        while text and text not in self.begins:
            text = text[1:]
        found = self.state_of.get(text)
        if found is None:
            found = self.state_of[text] = len(self.states)
            self.states.append(text)
            self.longest_at.append(self._end_token(text))
        if len(self.steps) >= CACHE_PAIRS:
            self.steps.clear()
        self.steps[state << 8 | byte] = found
        return found

    def merge(self, piece: bytes, down_to: int = 1) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals, until ``down_to`` parts are left."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no merge across their border comes before the merges that made them."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the later merge of the two sides again and again; a border merge of lower rank would have come first."""
        text, halves, ranks = self.bytes_of, self.halves, self.ranks
        until = len(text)  # border merges below this rank would have happened
        while True:
            across = ranks.get(text[left] + text[right])
            if across is not None and across < until:
                return False
            of_left, of_right = halves[left], halves[right]
            if of_left is None and of_right is None:
                return True
            # Of equal merges the one further left comes first, so the right side's own merge yields to an equal rank.
            if of_right is None or of_left is not None and left > right:
                until, left = min(until, left), of_left[1]
            else:
                until, right = min(until, right + 1), of_right[0]


class PrefixTable:
    """The last token of each prefix of ``piece``: ``last[i]`` belongs to its first ``i + 1`` bytes."""

    __slots__ = ("_read", "_state", "last", "piece", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self._read, self._state = 0, 0  # the automaton's state after so many bytes
        self.append(piece)

    def _extend(self, until: int) -> None:
        """Fill the entries up to ``until``: the longest suffix token that may follow what stands before it is the last one."""
        v, piece, last = self.vocabulary, self.piece, self.last
        steps, longest_at, shorter, size_of, pairs, fits = v.steps, v.longest_at, v.shorter, v.size_of, v._pairs, v.fits
        at, state = len(last), self._state
        if self._read != at:  # no state reaches further back than the longest token
            state = 0
            for byte in piece[max(0, at - v.longest) : at]:
                state = v.step(state, byte)
        for end in range(at, until):
            byte = piece[end]
            after = steps.get(state << 8 | byte)
            state = v.step(state, byte) if after is None else after
            token = longest_at[state]
            while (before := end - size_of[token]) >= 0 and not ((known := pairs.get(last[before] << 32 | token)) or known is None and fits(last[before], token)):
                token = shorter[token]
            last.append(token)
        self._read, self._state = until, state

    def append(self, more: bytes) -> None:
        self.piece += more
        self._extend(len(self.piece))

    def grown(self, more: bytes) -> PrefixTable:
        """A table of its own for this piece and ``more``."""
        table = object.__new__(PrefixTable)
        table.vocabulary, table.piece, table.last, table._read, table._state = self.vocabulary, self.piece, self.last.copy(), self._read, self._state
        table.append(more)
        return table

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; returns how many entries had to be worked out again."""
        old = self.last
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = old[:start]
        self._read = -1
        shift, settled, done = end - start - len(new), 0, 0
        fresh = start + len(new)
        while len(self.last) < len(self.piece):
            at = len(self.last)
            # Entries look back one longest token at most; so many equal ones in a row settle all that follow.
            if settled >= self.vocabulary.longest:
                self.last.extend(old[at + shift :])
                self._read = -1
                break
            self._extend(at + 1)
            done += 1
            settled = settled + 1 if at >= fresh + self.vocabulary.longest and old[at + shift] == self.last[at] else 0
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes (of all, if not given)."""
        end, found = len(self.last) if end is None else end, []
        last, size_of = self.last, self.vocabulary.size_of
        while end > 0:
            token = last[end - 1]
            found.append(token)
            end -= size_of[token]
        return found[::-1]


#: Unicode's white space besides the blank.
_SPACES = [chr(c) for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _loose(text: str) -> bool:
    """A blank stands beside other white space or at an end of the text; there a blank need not begin a piece."""
    return "  " in text or text[:1] == " " or text[-1:] == " " or any(w in text and (f" {w}" in text or f"{w} " in text) for w in _SPACES)


class Memory:
    """Values worked out once for keys in use: full, the new half takes the old one's place, and what is asked for comes back."""

    def __init__(self, work: Callable[[str], bytes]):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.work = work

    def miss(self, key: str) -> bytes:
        """The value of a key that ``new`` has not."""
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= 64:
            if len(self.new) >= CACHE_PIECES:
                self.old = self.new.copy()
                self.new.clear()  # the same object, as callers hold on to it
            self.new[key] = value
        return value


class Encoder:
    """Texts to ids piece by piece: each match of ``pattern`` is encoded by itself.

    A single blank between two visible characters always begins a match of the public pattern, so for that one a text may
    be cut before such blanks and every stretch looked up by itself; texts are not cut for other patterns.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.cuts_at_blanks = pattern == default_tokenizer()[1]
        self.vocabulary, self.split = vocabulary, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._heads: dict[bytes, PrefixTable] = {}
        self._pieces, self._stretches = Memory(self._piece), Memory(self._stretch)

    @staticmethod
    def _struct(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        known = piece[:1] == " " and self._stretches.new.get(piece[1:])
        if known:
            return known
        data = piece.encode()
        head = self._heads.get(start := data[:HEAD])
        if head is None:
            if len(self._heads) >= CACHE_HEADS:
                self._heads.clear()
            head = self._heads[start] = PrefixTable(self.vocabulary, start)
        return self._struct(head.grown(data[HEAD:]).ids())

    def _pack(self, text: str) -> bytes:
        known, work = self._pieces.new.get, self._pieces.miss
        return b"".join([known(piece) or work(piece) for piece in self.split(text)])

    def _stretch(self, stretch: str) -> bytes:
        # A blank and letters are one match of the public pattern.
        return self._piece(" " + stretch) if stretch.isascii() and stretch.isalpha() else self._pack(" " + stretch)

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text or not self.cuts_at_blanks or _loose(text):
            return self._pack(text or "")
        head, *rest = text.split(" ")
        known, work = self._stretches.new.get, self._stretches.miss
        return self._pack(head) + b"".join([known(s) or work(s) for s in rest])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, tokenizer: tuple[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and ``ids array<int>`` of every row's whole text; one row for each row given."""
    path, pattern = tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [coder.packed(t.as_py()) for t in part.column("text")]
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    tune(docs.sparkSession)
    return docs.selectExpr(f"`{key}` key", f"`{text}` text").mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def bpe_digests(docs: DataFrame, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Encodes and decodes every text in one pass; carries digests instead of ids, so nothing large leaves the worker."""
    path, pattern = tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in batch.column("text"):
                packed = coder.packed(t.as_py())
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
