"""Benchmark decontamination: CGK random walks, bit sampling over item-sized windows, exact edit verification.

Texts and items become sequences of words: runs of letters, marks and digits, A-Z lower-cased. Punctuation, white space and ASCII symbols
end words; each character of a script without spaces (Chinese, Japanese, Thai, ...) and each other symbol is a word of its own. An item of n words
is in a document if some run of its words is within n // 5 edits (insertions, deletions, replacements of a
word): a similarity of 0.8 or more; items of fewer than five words must occur as they are.

A CGK walk reads a sequence word by word and stays or moves on by a random bit of (step, word), so that few edits mean
few differing steps. As edits add up along a walk, items of more than PIECE words are walked in pieces of about equal length, all of them: one piece at
least has no more than its share of the edits, wherever they are. Pieces of about equal length (a factor of 1.25) form a group. A window of the group's size starts at
every word of every document; its walk is sampled at SAMPLED steps by each of TABLES tables, and windows that agree
with a piece in all samples of a table are candidates. Before the walk, windows are left out that can't match: of the first m
words of a match m less its edits are the piece's, so as many must be of the group's vocabulary. Candidates
are confirmed by the full edit distance between the item and the words around the window.

The benchmark goes to the tasks in blocks of at most about BLOCK items, one pass over the documents for each, and the driver holds one block at a
time; documents are never shuffled and nothing depends on other documents. Of matches of an item with equal edits in a row the first by its end counts. Very
long texts are searched whole. Nulls: a null or empty text has no words and matches nothing, and so does a null
or empty item; null ids are carried as they are. Repeated rows and repeated items are judged alike, each on its own; other
columns are carried along or left. An empty benchmark or table gives no rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, whole_row
from .spans import chunks, lean, mix, ragged, span_hashes, word_spans

BLOCK, EDITS, GROWTH = 20_000, 5, 1.25
WALKS, TABLES, SAMPLED, PIECE = 6, 24, 3, 64
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
#: Code points of scripts without spaces.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF),
    (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
_END, _WORD, _ALONE = range(3)


@cache
def _kinds() -> np.ndarray:
    """Of each code point whether it ends words, belongs to one or is one."""
    kinds = np.full(0x110000, _WORD, np.uint8)
    for a, b in UNSPACED:
        kinds[a : b + 1] = _ALONE
    for c in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)):
        category = unicodedata.category(chr(c))
        if category[0] in "PZ" or category == "Cc" or c in (0x200B, 0x2060, 0xFEFF):
            kinds[c] = _END
        elif category[0] == "S" and category != "Sk":
            kinds[c] = _ALONE
    return kinds


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the n + 1 offsets of the rows into them."""
    data, cuts = _PLAIN[data], offsets
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in range(1, 4):
            code = np.where(k < size, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
        kind = _kinds()[np.minimum(code, 0x10FFFF)]
        alone = kind == _ALONE
        cuts = np.union1d(offsets, np.concatenate([lead[alone], np.minimum(lead + size, len(data))[alone]]))
        for k in range(4):
            data[(lead + k)[(kind == _END) & (k < size) & (lead + k < len(data))]] = 0x20
    starts, ends, _ = word_spans(data, cuts)
    counts = np.diff(np.searchsorted(starts, offsets))
    return span_hashes(data, starts, ends), np.append(0, np.cumsum(counts))


class Index:
    """Items (id, text) and their pieces by groups of length, with the keys of the pieces' walks."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items: list[tuple[int | None, np.ndarray]] = []
        found: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for i, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if len(raw):
                h, _ = words(raw, np.array([0, len(raw)]))
                n = -(-len(h) // PIECE)
                for a, b in pairwise(len(h) * j // max(n, 1) for j in range(n + 1)):
                    found.setdefault(int(np.floor(np.log(b - a) / np.log(GROWTH) + 1e-9)), []).append((len(self.items), a, h[a:b]))
                self.items.append((i, h))
        self.groups = []
        for pieces in found.values():
            members = [h for _, _, h in pieces]
            m, most = min(map(len, members)), max(map(len, members)) // EDITS
            steps = max(1, 3 * m // 2)
            owner, start = np.array([x for x, _, _ in pieces]), np.array([a for _, a, _ in pieces])
            n = np.array([len(self.items[x][1]) for x in owner])
            slack = most + np.where(n > PIECE, n // EDITS, 0)
            rng = np.random.default_rng(m)
            picks = [np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(TABLES)]
            vocabulary = np.unique(np.concatenate(members))
            flat = np.concatenate([np.append(h, np.zeros(steps + 1, np.uint64)) for h in members])
            at = np.cumsum([0] + [len(h) + steps + 1 for h in members])[:-1]
            keys = [(np.sort(k), np.argsort(k, kind="stable")) for k in self.keys(flat, at, steps, picks)]
            self.groups.append((m, most, steps, picks, vocabulary, owner, start, slack, keys))

    @staticmethod
    def keys(h: np.ndarray, at: np.ndarray, steps: int, picks: list[np.ndarray]):
        """For each table the keys of the walks over h that start at `at`."""
        for w in range(WALKS):
            mine = range(w, TABLES, WALKS)
            if not mine:
                continue
            key = np.zeros((len(mine), len(at)), np.uint64)
            place, bits = at.copy(), None
            for j in range(steps):
                if j % 64 == 0:
                    bits = mix(h, 1000 + w * 16 + j // 64)
                for row, t in enumerate(mine):
                    if (picks[t] == j).any():
                        key[row] = mix(key[row] + h[place], t + 1)
                place += ((bits[place] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
            yield from key

    def matches(self, h: np.ndarray, offsets: np.ndarray):
        """(row, item id, edits, words of the item, end) of the best match of each item in each row; end: the word after it."""
        n, candidates = len(h), []
        for m, most, steps, picks, vocabulary, owner, start, slack, keys in self.groups:
            slots = 1 << 18
            seen = np.zeros(slots, bool)
            seen[(vocabulary & np.uint64(slots - 1)).astype(np.int64)] = True
            known = np.zeros(n + m + 1, np.int32)
            np.cumsum(seen[(h & np.uint64(slots - 1)).astype(np.int64)], out=known[1 : n + 1])
            known[n + 1 :] = known[n]
            at = np.flatnonzero(known[m : m + n] - known[:n] >= m - most)
            if not len(at):
                continue
            padded = np.append(h, np.zeros(steps + 1, np.uint64))
            found = []
            for key, (ordered, order) in zip(self.keys(padded, at, steps, picks), keys, strict=True):
                lo, hi = np.searchsorted(ordered, key, "left"), np.searchsorted(ordered, key, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    size = hi[hit] - lo[hit]
                    found.append(np.stack([np.repeat(at[hit], size), order[ragged(lo[hit], size)]]))
            if not found:
                continue
            place, piece = np.unique(np.concatenate(found, axis=1), axis=1)
            row = np.searchsorted(offsets, place, "right") - 1
            candidates.append(np.stack([row, owner[piece], place - start[piece], slack[piece]]))
        if candidates:
            row, item, place, slack = np.concatenate(candidates, axis=1)
            _, one = np.unique(np.stack([row, item, slack, place // (slack + 1)]), axis=1, return_index=True)
            yield from self.confirm(h, offsets, place[one], item[one], row[one], slack[one])

    def confirm(self, h, offsets, place, item, row, slack):
        lengths = np.array([len(x) for _, x in self.items])
        order = np.argsort(lengths[item], kind="stable")[::-1]
        place, item, row, slack = place[order], item[order], row[order], slack[order]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        a = b = 0
        while (a := b) < len(place):
            b = a + max(1, min(2000, (1 << 20) // int(lengths[item[a]])))
            p, i, r, most = place[a:b], item[a:b], row[a:b], slack[a:b]
            n = lengths[i]
            first = np.maximum(p - most, offsets[r])
            width = int((n + 3 * most).max()) + 2
            at = first[:, None] + np.arange(width)
            inside = at < np.minimum(offsets[r + 1], p + n + 2 * most + 2)[:, None]
            text = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
            wanted = np.full((len(p), int(n.max())), np.uint64(1), np.uint64)
            for k in range(len(p)):
                wanted[k, : n[k]] = self.items[i[k]][1]
            steps = np.arange(width + 1, dtype=np.int32)
            now = np.zeros((len(p), width + 1), np.int32)
            final = np.zeros_like(now)
            for k in range(wanted.shape[1]):
                new = now + 1
                new[:, 1:] = np.minimum(new[:, 1:], now[:, :-1] + (text != wanted[:, k : k + 1]))
                now = np.minimum.accumulate(new - steps, axis=1) + steps
                final[n == k + 1] = now[n == k + 1]
            edits = final.min(1)
            end = final.argmin(1)
            for k in np.flatnonzero(edits <= n // EDITS).tolist():
                key, value = (int(r[k]), int(i[k])), (int(edits[k]), int(first[k] + end[k] - offsets[r[k]]))
                best[key] = min(best.get(key, value), value)
        for (r, i), (edits, end) in best.items():
            yield r, self.items[i][0], edits, len(self.items[i][1]), end


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """(number of blocks, index) of the benchmark's blocks of about `size` items at most, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = -(-items.count() // size)
    if n > 1:
        items = table(items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    for b in range(n):
        part = items.filter(F.col("b") == b) if n > 1 else items
        yield n, Index([(r["item_id"], r["text"]) for r in part.collect()])


def _find(index: Index):
    @lean
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, _, data, offsets in chunks(batch.column("text")):
                rows = list(index.matches(*words(data, offsets)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + r] for r in cols[0]], pa.int64()), *(pa.array(list(c), pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "edits", "item_words", "end_word"])

    return run


def _clean(index: Index):
    @lean
    def run(batches):
        for batch in batches:
            rows, keep = batch.column("row"), np.ones(batch.num_rows, bool)
            for a, _, data, offsets in chunks(rows.field("text")):
                for r, *_ in index.matches(*words(data, offsets)):
                    keep[a + r] = False
            yield pa.RecordBatch.from_struct_array(rows).filter(pa.array(keep))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word: one row for each row of docs and item found in it."""
    kinds = "doc_id long, item_id long, edits long, item_words long, end_word long"
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for n, index in blocks(benchmark, block):
        found = texts.mapInArrow(_find(index), kinds)
        if n > 1:  # a block's index goes before the next one is made
            found = table(found, "leaks")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item is found."""
    for n, index in blocks(benchmark, block):
        docs = docs.select(whole_row(docs)).mapInArrow(_clean(index), docs.schema)
        if n > 1:
            docs = table(docs, "clean")
    return docs
