"""Sequential kernels that run on executors, on groups of bounded size.  Nothing here needs a Spark session."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_WORD = re.compile("[a-z0-9']+")


def ngram_counts(texts: pa.Array) -> list[dict]:
    """Of each text, by length of its word n-grams (1 to 3): normalised entropy, share of the top one, share of repeats,
    and the share of bigrams that occur more than once."""
    out = []
    for text in texts:
        words = _WORD.findall((text.as_py() or "").lower())
        found = {"entropy": {}, "top": {}, "repeated": {}, "more_bigrams": 0.0}
        for n in (1, 2, 3):
            counts = np.array(list(Counter(zip(*(words[i:] for i in range(n)), strict=False)).values()), np.float64)
            total = counts.sum()
            p = counts / total if total else counts
            found["entropy"][n] = float(-np.cumsum(p * np.log2(p))[-1] / np.log2(len(p))) if len(p) > 1 else 0.0
            found["top"][n] = float(p.max()) if len(p) else 0.0
            found["repeated"][n] = float((counts - 1).sum() / total) if total else 0.0
            if n == 2 and len(counts):
                found["more_bigrams"] = float((counts > 1).sum() / len(counts))
        out.append(found)
    return out


def ngram_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = ngram_counts(batch.column("text"))
        columns = [[x["entropy"][2] for x in stats], [x["entropy"][3] for x in stats], [x["top"][1] for x in stats], [x["repeated"][2] for x in stats], [x["more_bigrams"] for x in stats]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", "bigram_entropy", "trigram_entropy", "top_share", "repeated_bigrams", "more_bigrams"])


def mmr_order(query: np.ndarray, pool: np.ndarray, k: int, balance: float) -> list[int]:
    """Maximal marginal relevance over unit vectors; the first index wins ties."""
    relevance, chosen = pool @ query, []
    nearest = np.full(len(pool), -np.inf)
    while len(chosen) < min(k, len(pool)):
        value = relevance if not chosen else balance * relevance - (1 - balance) * nearest
        value = np.where(np.isin(np.arange(len(pool)), chosen), -np.inf, value)
        chosen.append(int(value.argmax()))
        nearest = np.maximum(nearest, pool @ pool[chosen[-1]])
    return chosen


def mmr_picker(k: int, balance: float):
    """A grouped function: rows of one query (rank, vec_id, embedding, q) to its bundle in order."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
        x, q = unit(np.array(group["embedding"].tolist(), np.float64)), unit(np.array(group["q"].iloc[0], np.float64))
        order = mmr_order(q, x, k, balance)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "pos": range(1, len(order) + 1), "vec_id": group["vec_id"].iloc[order].to_numpy()})

    return pick


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    """Similarity of two strings: shared characters within a window, transpositions, and a common beginning."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * boost * (1 - jaro)


def initial_matches(a: str, b: str) -> bool:
    """Whether the last words are equal, and one first word is the other's first letter ("J. Smith", "John Smith") or missing."""
    x, y = a.split(), b.split()
    if not x or not y or x[-1] != y[-1]:
        return False
    if len(x) == 1 or len(y) == 1:
        return len(x) != len(y)
    first, other = x[0].rstrip("."), y[0].rstrip(".")
    return (len(first) == 1 and other.startswith(first)) or (len(other) == 1 and first.startswith(other))


def same_name(a: str, b: str, least: float) -> bool:
    a, b = a.lower(), b.lower()
    return a == b or initial_matches(a, b) or jaro_winkler(a, b) >= least


def fresh_lines(lines: list[str], least: float = 0.92, last: int = 10) -> list[int]:
    """Positions of lines that equal no kept line (lowered, blanks squeezed) and resemble none of the ``last`` kept ones."""
    from difflib import SequenceMatcher

    keys, kept = set(), []
    out = []
    for i, line in enumerate(lines):
        key = " ".join(line.lower().split())
        if not key or key in keys:
            continue
        matcher = SequenceMatcher(None, autojunk=False)
        matcher.set_seq2(key)
        similar = False
        for other in kept[-last:]:
            matcher.set_seq1(other)
            if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least:
                similar = True
                break
        if not similar:
            keys.add(key)
            kept.append(key)
            out.append(i)
    return out


def line_filter(frames):
    """doc_id, text to doc_id, n_lines, n_kept and the kept text."""
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            lines = (text or "").split("\n")
            kept = fresh_lines(lines)
            rows.append((doc_id, len(lines), len(kept), "\n".join(lines[i] for i in kept)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_kept", "kept"])


def best_window(needle: str, hay: str, good: float = 0.95) -> float:
    """The best ratio of ``needle`` against stretches of ``hay`` of 80, 100 and 120 % of its length; 0 for needles under ten characters.

    Both are lowered and their blanks squeezed.  Stretches start a quarter of the needle apart, the last one of each length
    ends with the hay, and a ratio of ``good`` is good enough.
    """
    from difflib import SequenceMatcher

    needle, hay = " ".join(needle.lower().split()), " ".join(hay.lower().split())
    if len(needle) < 10 or not hay:
        return 0.0
    if needle in hay:
        return 1.0
    matcher, best, step = SequenceMatcher(None, autojunk=False), 0.0, max(1, len(needle) // 4)
    matcher.set_seq2(needle)
    for share in (100, 80, 120):
        size = max(1, len(needle) * share // 100)
        last = max(0, len(hay) - size)
        for at in (*range(0, last, step), last):
            matcher.set_seq1(hay[at : at + size])
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
                if best >= good:
                    return best
    return best


def within_budget(sizes: list[int], budget: int, most: int) -> list[int]:
    """Positions taken in order while they fit: one too large is passed over, and later ones may still fit."""
    taken, used = [], 0
    for i, size in enumerate(sizes):
        if len(taken) < most and used + size <= budget:
            taken.append(i)
            used += size
    return taken


def budget_picker(budget: int, most: int):
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        chosen = within_budget(group["tokens"].tolist(), budget, most)
        return group.iloc[chosen][["item_id", "rank", "doc_id", "tokens"]]

    return pick


def centroid_clusters(vectors: np.ndarray, least: float, most: int) -> list[int]:
    """Greedy clustering in order: a vector joins the nearest running-mean centroid if similar enough, or if no further
    cluster is allowed; otherwise it begins one."""
    centroids: list[np.ndarray] = []
    counts: list[int] = []
    out = []
    for v in vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12):
        scores = [float(v @ c / max(np.linalg.norm(c), 1e-12)) for c in centroids]
        best = int(np.argmax(scores)) if scores else -1
        if scores and (scores[best] >= least or len(centroids) >= most):
            counts[best] += 1
            centroids[best] = centroids[best] + (v - centroids[best]) / counts[best]
            out.append(best)
        else:
            centroids.append(v)
            counts.append(1)
            out.append(len(centroids) - 1)
    return out


def cluster_picker(least: float, most: int):
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        labels = centroid_clusters(np.array(group["embedding"].tolist(), np.float64), least, most)
        return pd.DataFrame({"query_id": group["query_id"].to_numpy(), "rank": group["rank"].to_numpy(), "vec_id": group["vec_id"].to_numpy(), "cluster": labels})

    return pick
