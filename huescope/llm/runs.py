"""Periodic runs of words: a harmonic grid of (period, grid point) pairs, whose longest common extensions are all searched at once.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
LEAST words and TIMES periods that no neighbouring word extends. The words that equal the one p places on make up a stretch of
length - p, so at least (TIMES - 1) p of them: every run of period p covers a point of the grid of that step, and a
document of n words has O(n log n) such points. From each point whose word is repeated p places on, the match is extended to both sides by
binary search over prefix hashes (two primes of 31 bits), for all points of a block at once. What is found is
deduplicated (a stretch found for several periods has the least, of which the others are multiples), then verified word by word; were a hash to
lie, the document is searched again without hashes.

Words are longest runs of bytes other than 0x20 and 0x09-0x0D, compared as they are. Planted repeats: with h =
crc32(doc_id in decimal) and g = floor(h / 10), where h % 10 = 0 each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 +
floor((n - a) / (3 + g % 8)).

Nulls: a null or empty text has no words, no runs and the digests of empty strings; a null doc_id has no planted repeat.
Very long texts stand alone in a chunk, and their grids are gone through in blocks of bounded size. Ties of the greatest exponent go to the smallest start, then period.
Repeated rows are rows of their own; columns other than doc_id and text are not read; an empty table gives no rows. No row is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import chunks, mix, ragged, word_spans

LEAST, TIMES = 6, 4
BLOCK = 1 << 19
PRIMES = (2147483647, 2147483629)
_U = np.uint64
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only (of the same call)."""
    size = ends - starts
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    held = data[ragged(starts, size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Prefixes:
    """Whether stretches of word ids are equal, by prefix hashes to two primes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for k, prime in enumerate(PRIMES):
            m, n = _U(prime), len(ids)
            power, done, base = np.ones(n + 1, _U), 1, (0x2545F4914F6CDD1D + 2 * k) % prime
            while done <= n:  # doubled: B^(done + i) = B^done * B^i
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * _U(pow(base, done, prime)) % m
                done += more
            value = mix(ids.astype(_U), 41 + k) % m
            self.sums.append(np.append(_U(0), np.cumsum(value * power[:n] % m)) % m)
            self.powers.append(power)

    def equal(self, at: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words at .. at + length equal those p places on."""
        out = np.ones(len(at), bool)
        for s, power, prime in zip(self.sums, self.powers, PRIMES, strict=True):
            m = _U(prime)
            near, far = s[at + length] + m - s[at], s[at + p + length] + m - s[at + p]
            out &= near % m * power[p] % m == far % m
        return out

    def extend(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, `most` at the most, match those p places on from `at` onwards, or back from there; binary searches of all at once."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            ok = self.equal(at[open_] - mid if back else at[open_], p[open_], mid)
            low[open_] = np.where(ok, mid, low[open_])
            high[open_] = np.where(ok, high[open_], mid - 1)
        return low


def grid(first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, period, point) of documents whose words begin at `first`; about BLOCK points each."""
    top = counts // TIMES
    ends = np.cumsum(top)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        pair = np.arange(at, min(total, at + BLOCK))
        doc = np.searchsorted(ends, pair, "right")
        p = pair - (ends[doc] - top[doc]) + 1
        step = np.maximum((TIMES - 1) * p, LEAST - p)
        points = (counts[doc] - p + step - 1) // step
        upto = np.cumsum(points)
        keep = max(1, int(np.searchsorted(upto, BLOCK, "right")))
        doc, p, step, points = doc[:keep], p[:keep], step[:keep], points[:keep]
        k = ragged(np.zeros(keep, np.int64), points)
        yield np.repeat(doc, points), np.repeat(p, points), np.repeat(first[doc], points) + k * np.repeat(step, points)
        at += keep


def _exact(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of one document's runs, period by period, without hashes."""
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(ids) // TIMES + 1):
        edge = np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a + p >= max(LEAST, TIMES * p):
                best.setdefault((a, b - a + p), p)
    return sorted((a, n, p) for (a, n), p in best.items())


def _true(ids: np.ndarray, start: np.ndarray, length: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each stretch has the period, word by word, and neither neighbour within low .. high goes on with it."""
    out = np.ones(len(start), bool)
    size = length - p
    for a in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1):
        x = ragged(start[a], size[a])
        owner = np.repeat(a, size[a])
        out[owner[ids[x] != ids[x + np.repeat(p[a], size[a])]]] = False
    end = start + length
    before, after = start > low, end < high
    out[before] &= ids[start[before] - 1] != ids[start[before] - 1 + p[before]]
    out[after] &= ids[end[after]] != ids[end[after] - p[after]]
    return out


def find_runs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(document, start, length, period) rows, by document, start and period; ids: the documents' words one after the other."""
    first = np.cumsum(counts) - counts
    prefixes, found = Prefixes(ids), []
    for doc, p, at in grid(first, counts):
        hit = np.flatnonzero(ids[at] == ids[at + p])
        doc, p, at = doc[hit], p[hit], at[hit]
        end = first[doc] + counts[doc]
        on = prefixes.extend(at, p, end - p - at, False)
        back = prefixes.extend(at, p, at - first[doc], True)
        length = on + back + p
        good = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack([doc, at - back, length, p], 1)[good], axis=0))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    rows = rows[np.append(True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(1))] if len(rows) else rows  # of a stretch its least period
    doc, start, length, p = rows.T
    ok = _true(ids, start, length, p, first[doc], first[doc] + counts[doc])
    rows = np.stack([doc, start - first[doc], length, p], 1)
    if not ok.all():
        bad = np.unique(doc[~ok])
        again = [(d, *r) for d in bad.tolist() for r in _exact(ids[first[d] : first[d] + counts[d]])]
        rows = np.concatenate([rows[~np.isin(doc, bad)], np.array(again, np.int64).reshape(-1, 4)])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted(counts: np.ndarray, crc: list[int | None]) -> np.ndarray:
    """The word that stands at each place, by place in the original words of all documents."""
    out = np.arange(int(counts.sum()))
    first = np.cumsum(counts) - counts
    for d, h in enumerate(crc):
        n = int(counts[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            i = np.arange(a, n)
            out[first[d] + a : first[d] + n] = first[d] + a + (i - a) % p
    return out


def _greatest(rows: list[list[int]]) -> list[int]:
    """Of (start, length, period) the one of greatest length / period, ties to the smallest start, then period."""
    best = rows[0]
    for r in rows[1:]:  # by start and period already
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _runs(plant: bool):
    def run(batches):
        for batch in batches:
            ids, crcs = batch.column("doc_id"), batch.column("crc")
            for a, b, data, offsets in chunks(batch.column("text")):
                starts, ends, counts = word_spans(data, offsets)
                if plant:
                    source = planted(counts, crcs.slice(a, b - a).to_pylist())
                    starts, ends = starts[source], ends[source]
                rows = find_runs(word_ids(data, starts, ends), counts)
                first = np.cumsum(counts) - counts
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
                np.add.at(depth, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
                kept = np.cumsum(depth)[:-1] == 0
                size = np.where(kept, ends - starts + 1, 0)
                full = np.append(data, np.uint8(0))[ragged(starts, size)]  # each kept word and the byte after it, which becomes a space
                upto = np.append(0, np.cumsum(size))
                full[upto[1:][kept] - 1] = 0x20
                text = memoryview(np.ascontiguousarray(full))
                lo, hi = upto[first].tolist(), upto[first + counts].tolist()
                collapsed = [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(lo, hi, strict=True)]
                cut = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                best, digests = [], []
                for i in range(b - a):
                    own = rows[cut[i] : cut[i + 1], 1:].tolist()
                    best.append(_greatest(own) if own else [None] * 3)
                    digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
                milli = [None if n is None else 1000 * n // p for _, n, p in best]
                columns = [ids.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(np.diff(cut), pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*best, strict=True)), pa.array(milli, pa.int64()), pa.array(digests), pa.array(collapsed)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def document_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Of each row of docs (doc_id, text): n_words, n_runs, the greatest run (nulls without runs), exponent_milli and the digests of its runs and of what is left.

    What is left is each word that no run holds after its first period, joined by single spaces. plant: see above.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("string")).alias("crc"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_runs(plant), SCHEMA)
