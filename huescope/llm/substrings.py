"""Repeated passages of words: suffix automata of reference shards, past which documents' stretches are streamed.

A window is `window` consecutive words of one document; it goes where its words also start in a document of a smaller
doc_id. To send every document past every shard would be quadratic, so shards are dealt by content first. A window's
anchor is the least hash of its runs of `gram` words: equal windows have equal anchors, neighbours mostly share one, and a document has
about one for every 17 words. Neighbouring windows of one anchor are a run, hashed whole. Equal runs belong to the smallest doc_id that has them, which owns their windows as far as others are concerned.
Only where an anchor has several different runs (at the ends of passages, around edits) their first occurrences are compared window by window, by a hash of each, and
a window belongs to the smallest doc_id among these. What a document owns that others have, in maximal stretches, is reference text; what others own of it are its queries, which go
to the owner's shard.

A shard holds the references of some owners, about SHARD characters. Its suffix automaton runs over words, not hashes, with the smallest doc_id
of each state's occurrences; a query is streamed through it for matching statistics (how long a match ends at each word), cut back to the states that stand for the last
`window` words. Where these have a smaller doc_id, the window goes; maximal spans of such windows are removed. A shard with many queries is sent to
as many tasks as these need (about QUERY characters each), so that a passage that a third of all documents hold is no single task's work.

Words are longest runs of bytes other than 0x20 and 0x09-0x0D, compared as they are. Anchors and windows are looked for by hashes of 64 bits: two different windows of one hash, of n windows n * n / 2**65 on
average, can hide a repeat, never make one.

Nulls: a null or empty text, or one of less than `window` words, loses nothing. A null doc_id counts after all others. Rows that share a doc_id don't remove
each other's words, so repeated rows stay alike. Very long texts stand alone in a chunk. Columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table, whole_row
from .spans import chunks, mix, powers, ragged, span_hashes, word_spans

WINDOW, GRAM = 50, 16
SHARD, QUERY = 1 << 19, 1 << 22
LAST = 2**63 - 1
_U = np.uint64
_STEP = 0x9FB21C651E98DF25


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashed words, put together from runs of powers of two."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out, done, part, size = np.zeros(n, _U), 0, words, 1
    while size <= width:
        if width & size:
            out = out * _U(pow(_STEP, size, 2**64)) + part[done : done + n]
            done += size
        part = part[:-size] * _U(pow(_STEP, size, 2**64)) + part[size:]
        size *= 2
    return mix(out, 51)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


class Windows:
    """The words of a chunk's documents and their runs: `doc`, `place` (of the first word), `number` (of windows), `anchor`, `whole` (a hash of all its words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.counts = word_spans(data, offsets)
        self.first = np.cumsum(self.counts) - self.counts
        hashes = span_hashes(data, self.starts, self.ends)
        number = np.maximum(self.counts - window + 1, 0)
        at, doc = ragged(self.first, number), np.repeat(np.arange(len(number)), number)
        anchor = least_of(rolled(hashes, gram), window - gram + 1)[at] if len(at) else np.zeros(0, _U)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))[: len(at)])
        self.doc, self.anchor, self.number = doc[new], anchor[new], np.diff(np.append(new, len(at)))
        self.place = at[new] - self.first[self.doc]
        up, down = powers(len(hashes) + 1, 0)
        total = np.append(_U(0), np.cumsum(hashes * up[: len(hashes)]))
        size = self.number + window - 1
        self.whole = mix((total[at[new] + size] - total[at[new]]) * down[at[new]] + size.astype(_U), 52)

    def lists(self) -> pa.Array:
        """A list of runs a document."""
        cut = np.searchsorted(self.doc, np.arange(len(self.counts) + 1))
        columns = [pa.array(self.anchor.view(np.int64)), pa.array(self.whole.view(np.int64)), pa.array(self.place, pa.int32()), pa.array(self.number, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(columns, ["anchor", "whole", "place", "number"]))


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words joined by single spaces."""
    size = ends - starts + 1
    out = np.append(data, np.uint8(0))[ragged(starts, size)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes().decode("utf-8", "surrogatepass")


def _runs(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                w = Windows(data, offsets, window, gram)
                text = [words_of(data, w.starts[x : x + n], w.ends[x : x + n]) if n else "" for x, n in zip(w.first.tolist(), w.counts.tolist(), strict=True)]
                columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "rank", "tie")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.counts, pa.int64()), pa.array(text, pa.string()), w.lists()], ["doc_id", "rank", "tie", "n_words", "kept", "runs"])

    return run


def _hashes(window: int):
    """The places and hashes of all windows of the given runs (place, number) of each document."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                starts, ends, counts = word_spans(data, offsets)
                first = np.cumsum(counts) - counts
                runs = batch.column("runs").slice(a, b - a)
                size = runs.value_lengths().to_numpy()
                place, number = (runs.flatten().field(x).to_numpy().astype(np.int64) for x in ("place", "number"))
                doc = np.repeat(np.repeat(np.arange(b - a), size), number)
                place = ragged(place, number)
                whole = rolled(span_hashes(data, starts, ends), window)[first[doc] + place] if len(doc) else np.zeros(0, _U)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                held = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(whole.view(np.int64))], ["place", "hash"])
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("rank", "tie")] + [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), held)], ["rank", "tie", "windows"])

    return run


def _stretches(window: int):
    """Maximal stretches of a document's repeated windows of one owner."""

    def run(batches):
        for batch in batches:
            ranks, ties = batch.column("rank").to_pylist(), batch.column("tie").to_pylist()
            for a, b, data, offsets in chunks(batch.column("text")):
                starts, ends, counts = word_spans(data, offsets)
                first = np.cumsum(counts) - counts
                out: list[tuple] = []
                for i in range(b - a):
                    found = batch.column("found")[a + i].values
                    place, number, owner = (found.field(x).to_numpy() for x in ("place", "number", "owner"))
                    owner, place = np.unique(np.stack([np.repeat(owner, number), ragged(place.astype(np.int64), number)]), axis=1)
                    cut = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(owner) != 0)))
                    for x, y in zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(place) - 1], strict=True):
                        p, q = first[i] + place[x], first[i] + place[y] + window
                        out.append((int(owner[x]), ranks[a + i], ties[a + i], int(place[x]), words_of(data, starts[p:q], ends[p:q])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["owner", "rank", "tie", "place", "text"])

    return run


class Automaton:
    """The suffix automaton of several texts of words, with the least rank of the texts in which what a state stands for occurs."""

    def __init__(self) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [LAST]

    def _state(self, to: dict[str, int], link: int, size: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.size.append(size)
        self.least.append(LAST)
        return len(self.to) - 1

    def _split(self, p: int, w: str) -> int:
        """The state for what p stands for and w: the one there, or a part of it that is split off."""
        q = self.to[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        part = self._state(dict(self.to[q]), self.link[q], self.size[p] + 1)
        self.link[q] = part
        while p >= 0 and self.to[p].get(w) == q:
            self.to[p][w] = part
            p = self.link[p]
        return part

    def add(self, words: list[str], rank: int) -> None:
        to, link, last = self.to, self.link, 0
        for w in words:
            if w in to[last]:
                last = self._split(last, w)
            else:
                p, last = last, self._state({}, 0, self.size[last] + 1)
                while p >= 0 and w not in to[p]:
                    to[p][w] = last
                    p = link[p]
                if p >= 0:
                    link[last] = self._split(p, w)
            if rank < self.least[last]:
                self.least[last] = rank

    def close(self) -> None:
        """Tell each state what its longer contexts know; after the last add()."""
        for s in np.argsort(-np.array(self.size), kind="stable").tolist():
            up = self.link[s]
            if up >= 0 and self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def matches(self, words: list[str], window: int) -> list[int]:
        """For each word the least rank that has the `window` words that end there, LAST if none has."""
        to, link, size, least = self.to, self.link, self.size, self.least
        s, n, out = 0, 0, []
        for w in words:
            while s and w not in to[s]:
                s = link[s]
                n = size[s]
            s = to[s].get(w, 0)
            n = n + 1 if s else 0
            if n >= window:
                while size[link[s]] >= window:
                    s = link[s]
                n = min(n, size[s])
            out.append(least[s] if n >= window else LAST)
        return out


def _removed(window: int):
    """(rank, tie, from, upto) spans of words to remove, of a shard's queries."""

    def run(group: pa.Table) -> pa.Table:
        automaton, queries, known = Automaton(), [], {}
        for owner, rank, tie, place, text in zip(*(group.column(c).to_pylist() for c in ("owner", "rank", "tie", "place", "text")), strict=True):
            if owner == rank:
                automaton.add(text.split(" "), rank)
            else:
                queries.append((rank, tie, place, text))
        automaton.close()
        spans: list[tuple[int, int, int, int]] = []
        for rank, tie, place, text in queries:
            if text not in known:
                known[text] = np.array(automaton.matches(text.split(" "), window), np.int64)
            end = np.flatnonzero(known[text] < rank) + 1 + place
            cut = np.flatnonzero(np.append(True, np.diff(end) > window)) if len(end) else end
            spans += [(rank, tie, int(end[x]) - window, int(end[y])) for x, y in zip(cut, [*(cut[1:] - 1), len(end) - 1], strict=True)] if len(end) else []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*spans, strict=True) if spans else [[]] * 4, kinds, strict=True)], ["rank", "tie", "from", "upto"])

    return run


def _cut(batches):
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            starts, ends, counts = word_spans(data, offsets)
            first, kept, gone = np.cumsum(counts) - counts, [], []
            for i in range(b - a):
                spans, n = batch.column("spans")[a + i].values, int(counts[i])
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, spans.field("from").to_numpy(), 1)
                np.add.at(depth, spans.field("upto").to_numpy(), -1)
                at = first[i] + np.flatnonzero(np.cumsum(depth)[:n] == 0)
                kept.append(words_of(data, starts[at], ends[at]) if len(at) else "")
                gone.append(n - len(at))
            columns = [batch.column(c).slice(a, b - a) for c in ("rank", "tie", "spans")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["rank", "tie", "spans", "n_removed", "kept"])


_CUT = "rank long, tie long, spans array<struct<`from`:int,upto:int>>, n_removed long, kept string"


def _texts(docs: DataFrame) -> DataFrame:
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, rank, tie, n_words, digest of all words; cut: rank, tie, spans, the words to remove as [from, upto), n_removed, kept, the others, of each that loses some).

    rank is the doc_id, or LAST for null; tie a hash of the text.
    """
    texts = _texts(docs)
    rows = texts.mapInArrow(_runs(window, gram), "doc_id long, rank long, tie long, n_words long, kept string, runs array<struct<anchor:bigint,whole:bigint,place:int,number:int>>")
    rows = table(rows.select("doc_id", "rank", "tie", "n_words", F.sha2("kept", 256).alias("digest"), "runs"), "rows")
    runs = rows.select("rank", "tie", F.explode("runs").alias("r")).select("rank", "tie", "r.*")
    owned = [F.min("rank").alias("owner"), F.max("rank").alias("last")]
    shared = runs.groupBy("anchor").agg(*owned, (F.min("whole") != F.max("whole")).alias("open")).filter("owner < last").select("anchor", "open")
    met = table(runs.join(shared, "anchor"), "runs")
    kinds = table(met.groupBy("anchor", "whole").agg(*owned), "kinds")
    own = table(met.join(kinds, ["anchor", "whole"]).filter("open or owner < last").select("rank", "tie", "place", "number", "owner", "last", "open"), "owned")
    drop(met, kinds)
    held = own.groupBy("rank", "tie").agg(F.collect_set(F.struct("place", "number", "owner", "last", "open")).alias("runs"))
    held = table(texts.join(held, ["rank", "tie"]).select("rank", "tie", "runs", "text"), "texts")  # of those that share something
    drop(own)
    pick = lambda keep: F.transform(F.filter("runs", keep), lambda r: F.struct(r["place"].alias("place"), r["number"].alias("number"), r["owner"].alias("owner")))
    firsts = held.withColumn("runs", pick(lambda r: r["open"] & (r["owner"] == F.col("rank")))).filter(F.size("runs") > 0)
    windows = table(firsts.mapInArrow(_hashes(window), "rank long, tie long, windows array<struct<place:int,hash:bigint>>"), "windows")
    hashed = windows.select("rank", "tie", F.explode("windows").alias("w")).select("rank", "tie", "w.*")
    repeated = table(hashed.groupBy("hash").agg(*owned).filter("owner < last").select("hash", "owner"), "repeated")
    single = hashed.join(repeated, "hash").groupBy("rank", "tie").agg(F.collect_list(F.struct("place", F.lit(1).alias("number"), "owner")).alias("found"))
    whole = held.withColumn("found", pick(lambda r: r["owner"] < r["last"])).filter(F.size("found") > 0).select("rank", "tie", "found", "text")
    parts = whole.union(firsts.join(single, ["rank", "tie"]).select("rank", "tie", "found", "text"))
    parts = table(parts.mapInArrow(_stretches(window), "owner long, rank long, tie long, place int, text string"), "stretches")
    drop(windows, repeated)
    size, reference = F.length("text"), F.col("owner") == F.col("rank")
    total = parts.agg(F.sum(F.when(reference, size))).first()[0] or 0
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(total // SHARD + 1)))
    copies = parts.groupBy("shard").agg((F.floor(F.sum(F.when(~reference, size).otherwise(0)) / QUERY) + 1).cast("int").alias("copies"))
    own_copy = F.array(F.pmod(F.xxhash64("rank", "tie", "place"), F.col("copies")).cast("int"))
    dealt = parts.join(copies, "shard").withColumn("copy", F.explode(F.when(reference, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(own_copy)))
    spans = dealt.select("shard", "copy", "owner", "rank", "tie", "place", "text").groupBy("shard", "copy").applyInArrow(_removed(window), "rank long, tie long, `from` int, upto int")
    spans = table(spans.groupBy("rank", "tie").agg(F.collect_list(F.struct("from", "upto")).alias("spans")), "spans")
    cut = held.join(spans, ["rank", "tie"]).select("rank", "tie", "spans", "text").mapInArrow(_cut, _CUT)
    return rows, cut.dropDuplicates(["rank", "tie"])


def substring_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) of each row of docs."""
    rows, cut = repeated_spans(docs, window)
    out = rows.drop("runs").join(cut.select("rank", "tie", "n_removed", F.sha2("kept", 256).alias("less")), ["rank", "tie"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("less", "digest").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without their repeated passages: texts that lose words are what is kept, joined by single spaces, others are as they were."""
    cut = repeated_spans(docs, window)[1].select("rank", "tie", "kept")
    keyed = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("tie"))
    out = keyed.join(cut, ["rank", "tie"], "left")
    return out.select(F.when(F.col("kept").isNull(), F.col("row")).otherwise(F.col("row").withField("text", F.col("kept"))).alias("row")).select("row.*")


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hits AS (SELECT win.r, win.i FROM win JOIN firsts USING (s) WHERE firsts.least < win.doc_id),
gone AS (SELECT DISTINCT r, i + unnest(range(0, 50)) AS j FROM hits),
left_ AS (SELECT k.r, string_agg(k.v, ' ' ORDER BY k.j) AS kept, count(*) AS n FROM (SELECT r, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS j FROM w) k LEFT JOIN gone g ON g.r = k.r AND g.j = k.j WHERE g.j IS NULL GROUP BY k.r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ l ON l.r = w.r
"""
