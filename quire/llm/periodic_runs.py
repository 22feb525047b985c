"""Runs of repeating words found by online square catching (operator 11).

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal), at least ``shortest`` and ``times * q`` words long, that no
neighbouring word extends keeping the period.

``Catchers`` takes the words of one text as they are appended, in pieces of
any size.  For every level ``s`` (a power of two) each completed block of ``s``
words at a multiple of ``s`` becomes a catcher, which waits for the block to come
again ``s + 1`` to ``2 s`` words later (``1`` to ``2 s`` at the lowest level).
An appended word so meets one catcher of each level: the suffix of ``s`` words
that it ends is compared with that block by a fingerprint, which grows out of
two fingerprints of the level below.  A match is a piece of a square of that
period.  Matches of neighbouring blocks at one distance merge; the ends of
what they merge to are found by comparing ever shorter suffixes, and squares
of the same stretch at multiples of a period fall together under the least.

Nothing is missed: a run of period ``q`` in ``s + 1 .. 2 s`` has a whole block
in its first ``2 s - 1`` words, and the block's copy ``q`` words later ends
within ``2 s - 1 + q < 3 q`` words.  Accepted runs are compared word by word; a
fingerprint collision found so starts the text again with other fingerprints.
Work is ``n log n`` for ``n`` words, memory too.

Each text is handled by itself in the task that reads it, so nothing is
shuffled and no key can gather rows.

Defined cases: a null or empty text has no words and no runs; rows that repeat
(doc_id included) give a row each; a null doc_id is passed through; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import words_of

PIECE = 1 << 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Catchers:
    """The runs of a growing sequence of word numbers."""

    def __init__(self, shortest: int = 24, times: int = 3, seed: int = 0) -> None:
        if times < 3:
            raise ValueError("a run needs at least three periods")
        self.shortest, self.times, self.seed = shortest, times, seed
        self.lowest = max(0, ((shortest + 1) // 3).bit_length() - 1)
        self.numbers = np.zeros(0, dtype="int64")
        #: Fingerprints of the 2^k words that end at each place; the levels below ``lowest`` only lead there.
        self.prints: list[np.ndarray] = []
        self.matches: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def append(self, numbers: np.ndarray) -> None:
        """Take more words; every one of them advances the comparisons of all levels."""
        self.numbers = np.concatenate([self.numbers, numbers]) if len(self.numbers) else numbers
        n, k = len(self.numbers), 0
        while k <= self.lowest or self.times << k <= n:
            if k == len(self.prints):
                self.prints.append(np.zeros(0, dtype="uint64"))
                self.matches.append([])
            old = len(self.prints[k])
            self.prints[k] = new = self.fingerprints(k, old, n)
            if k >= self.lowest:
                self.catch(k, new, old, n, 2)
            if k == self.lowest:
                self.catch(k, new, old, n, 1)
            k += 1

    def fingerprints(self, k: int, old: int, n: int) -> np.ndarray:
        if k == 0:
            new = mixed((self.numbers[old:].astype("uint64") + np.uint64(2 * self.seed + 1)) * np.uint64(0x9E3779B97F4A7C15))
        else:
            half, below = 1 << (k - 1), self.prints[k - 1]
            new, at = np.zeros(n - old, dtype="uint64"), max(old, half)
            if at < n:
                new[at - old:] = mixed(below[at - half:n - half] * np.uint64(0x94D049BB133111EB) + below[at:n])
        return np.concatenate([self.prints[k], new]) if old else new

    def catch(self, k: int, prints: np.ndarray, old: int, n: int, reach: int) -> None:
        """Compare the suffix at each new place with the block that ended ``(reach - 1) s + 1`` to ``reach * s`` words ago."""
        s = 1 << k
        first = max(old, reach * s)
        if first >= n:
            return
        places = np.arange(first, n)
        blocks = ((places >> k) - (reach - 1) << k) - 1
        hit = np.flatnonzero(prints[first:n] == prints[blocks])
        if len(hit):
            self.matches[k].append((places[hit] - blocks[hit], blocks[hit]))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs in the words so far, by start and period."""
        n, found = len(self.numbers), []
        for k, matches in enumerate(self.matches):
            if not matches:
                continue
            s = 1 << k
            gap, block = (np.concatenate(x) for x in zip(*matches))
            order = np.lexsort((block, gap))
            gap, block = gap[order], block[order]
            cut = np.flatnonzero((np.diff(gap) != 0) | (np.diff(block) != s))
            left = block[np.concatenate([[0], cut + 1])] - s + 1
            right, gap = block[np.concatenate([cut, [len(block) - 1]])], gap[np.concatenate([cut, [len(gap) - 1]])]
            for j in range(k - 1, -1, -1):  # less than a block remains on either side
                h, prints = 1 << j, self.prints[j]
                at = np.maximum(left - 1, 0)
                left = left - h * ((left >= h) & (prints[at] == prints[at + gap]))
                end = right + gap + h
                at = np.minimum(end, n - 1)
                right = right + h * ((end < n) & (prints[at - gap] == prints[at]))
            length = right + gap - left + 1
            keep = length >= np.maximum(self.shortest, self.times * gap)
            found.append(np.stack([left[keep], length[keep], gap[keep]], axis=1))
        if not found:
            return []
        runs = np.concatenate(found)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        fresh = np.ones(len(runs), dtype=bool)
        fresh[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
        return sorted(map(tuple, runs[fresh].tolist()), key=lambda r: (r[0], r[2]))

    def confirmed(self, runs: list[tuple[int, int, int]]) -> bool:
        """Whether the words themselves bear the runs out."""
        x = self.numbers
        return all(np.array_equal(x[a:a + size - q], x[a + q:a + size]) for a, size, q in runs)


def runs_of(words: list[bytes], shortest: int = 24, times: int = 3, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period."""
    if len(words) < max(shortest, times):
        return []
    known: dict[bytes, int] = {}
    number = known.setdefault
    numbers = np.fromiter((number(w, len(known)) for w in words), dtype="int64", count=len(words))
    seed = 0
    while True:
        catchers = Catchers(shortest, times, seed)
        for at in range(0, len(numbers), piece):
            catchers.append(numbers[at:at + piece])
        runs = catchers.runs()
        if catchers.confirmed(runs):
            return runs
        seed += 1


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for a, size, q in runs:
        keep[a + q:a + size] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def periodic_runs(docs: DataFrame, *, shortest: int = 24, times: int = 3, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_words, runs, text`` for every row of ``docs(doc_id, text)``.

    ``runs`` are (start, length, period) by start and period; ``text`` is the
    whole text's words with every run collapsed to its first period, joined by
    single spaces.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, found, texts = [], [], []
                for text in part.column("text"):
                    words = words_of(text.as_py(), lower=False)
                    runs = runs_of(words, shortest, times, piece)
                    sizes.append(len(words))
                    found.append([{"start": a, "length": size, "period": q} for a, size, q in runs])
                    texts.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

    kept = docs.select("doc_id", "text")
    doc_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {doc_type}, n_words long, runs array<{RUN}>, text string")
