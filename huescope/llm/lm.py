"""Language-model scores: a subword lattice under words, words under classes of documents.

Words of texts (A-Z lower-cased) and one end a document are the tokens; documents with held = false are learned from. A word's lattice has an
arc for every piece of an existing vocabulary at every place where its bytes occur, and a stop at the end; the
weight of a piece starts from the vocabulary's own scores (ranks: 1 / (rank + OFFSET)) and is learned by expectation-maximisation over the types of the
training tokens. The lattice's probability of a word is the sum over all segmentations, by the forward recursion in
log space, with weights for each class of documents (the CLASSES most frequent `lang`s of training documents and one for the rest, null included). A
word's probability in a class is its discounted share of the class's tokens plus the discounted mass (absolute discounting, by the
counts of counts) times its base: the lattice's, with a part POOLED of the same estimate over all training tokens. A text's probability is the sum over classes of the class's share times the product over
tokens - a proper distribution over token sequences, marginal over segmentations and classes.

Counts are gathered over all training documents, aggregated in each task before the shuffle. The most frequent words, HEAD at most (of words
about as frequent all or none), go to the tasks; all others meet their documents in a join on the word's hash (64 bits), so nothing that grows is broadcast.
Hot words are among the head. Nulls: a null text is empty and has the end alone; a null held is training. Without training
tokens all words are novel. Repeated rows are rows of their own; ties among words or classes are by hash or name; very long texts and words are scored
whole, in a chunk of their own; other columns, whatever their names, are left; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .spans import LOWER, Spans, chunks, mix, ragged, span_hashes, word_spans

HEAD, CLASSES, ROUNDS, OFFSET = 200_000, 8, 2, 50.0
POOLED, END, LINEAR = 0.1, 0.01, 24
_FLUSH, _GATHER, _CELLS = 1_000_000, 100_000, 300_000
_START = "▁".encode()


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b)), by numpy's vector instructions; -inf is nothing."""
    most = np.maximum(a, b)
    least = np.minimum(a, b)
    return np.where(least == -np.inf, most, most + np.log(1.0 + np.exp(least - np.where(most == -np.inf, 0.0, most))))


class Lattice:
    """All segmentations of words into pieces (byte strings)."""

    def __init__(self, pieces: list[bytes]):
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        h = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), ends - lengths, ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes = np.unique(lengths).tolist()

    def arcs(self, data: np.ndarray, starts: np.ndarray, size: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of the arcs of words of one size, by their end."""
        found, spans = [], Spans(data)
        for length in self.sizes:
            if length > size:
                break
            at = (starts[None, :] + np.arange(size - length + 1)[:, None]).ravel()
            h = spans.hashes(at, at + length)
            hit = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            good = self.hashes[k] == h[hit]
            hit, piece = hit[good], self.order[k[good]]
            cuts = np.searchsorted(hit, np.arange(size - length + 2) * len(starts)).tolist()
            found += [(s, s + length, hit[x:y] - s * len(starts), piece[x:y]) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        return sorted(found, key=lambda arc: arc[1])

    def run(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray | None = None, cls: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each word under each row of logs (the pieces' and, last, the stop's). With counts (as logs) nothing is returned but
        each word's expected pieces under its own row, cls (by default the first), are added to them."""
        out = np.empty((len(logs), len(words) if counts is None else 0))
        raw = [_START + w for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            size = int(sizes[mine[0]])
            step = max(1, _CELLS // size)
            for a in range(0, len(mine), step):
                part = mine[a : a + step]
                text = data[ragged(starts[part], np.full(len(part), size))]
                arcs = self.arcs(text, np.arange(len(part)) * size, size)
                if counts is None:
                    for k, log_p in enumerate(logs):
                        out[k, part] = self._forward(arcs, size, len(part), log_p)
                else:
                    row = np.zeros(len(part), np.int64) if cls is None else cls[part]
                    (self._expect_linear if size <= LINEAR else self._expect_log)(arcs, size, row, logs, counts.reshape(logs.shape))
        return out

    @staticmethod
    def _forward(arcs, size, n, log_p):
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0.0
        for s, e, w, p in arcs:
            row = forward[e]
            row[w] = _add(row[w], forward[s][w] + log_p[p])
        return forward[size] + log_p[-1]

    @staticmethod
    def _expect_linear(arcs, size, row, logs, counts):
        """For words so short that no product of weights gets too small for a double."""
        width, p_all = logs.shape[1], np.exp(logs).ravel()
        forward, backward = np.zeros((2, size + 1, len(row)))
        forward[0] = backward[size] = 1.0
        keys = [row[w] * width + p for _, _, w, p in arcs]
        weights = [p_all[key] for key in keys]
        for (s, e, w, _), x in zip(arcs, weights, strict=True):
            forward[e][w] += forward[s][w] * x
        whole = np.where(forward[size] > 0, forward[size], 1.0)
        used: list[np.ndarray] = [np.zeros(0)] * len(arcs)
        for i in sorted(range(len(arcs)), key=lambda i: -arcs[i][0]):
            s, e, w, _ = arcs[i]
            onward = backward[e][w] * weights[i]
            backward[s][w] += onward
            used[i] = forward[s][w] * onward / whole[w]
        if arcs:
            counts += np.bincount(np.concatenate(keys), np.concatenate(used), minlength=counts.size).reshape(counts.shape)
        counts[:, -1] += np.bincount(row, minlength=len(counts))

    @staticmethod
    def _expect_log(arcs, size, row, logs, counts):
        width = logs.shape[1]
        forward, backward = np.full((2, size + 1, len(row)), -np.inf)
        forward[0] = backward[size] = 0.0
        keys = [row[w] * width + p for _, _, w, p in arcs]
        weights = [logs.ravel()[key] for key in keys]
        for (s, e, w, _), x in zip(arcs, weights, strict=True):
            forward[e][w] = _add(forward[e][w], forward[s][w] + x)
        whole = np.where(forward[size] > -np.inf, forward[size], 0.0)
        used: list[np.ndarray] = [np.zeros(0)] * len(arcs)
        for i in sorted(range(len(arcs)), key=lambda i: -arcs[i][0]):
            s, e, w, _ = arcs[i]
            onward = backward[e][w] + weights[i]
            backward[s][w] = _add(backward[s][w], onward)
            used[i] = np.exp(forward[s][w] + onward - whole[w])
        if arcs:
            counts += np.bincount(np.concatenate(keys), np.concatenate(used), minlength=counts.size).reshape(counts.shape)
        counts[:, -1] += np.bincount(row, minlength=len(counts))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece model and log weights by their scores, the stop's last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        score = model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or score < -1e8:
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            key, score = bytes([int(piece[3:5], 16)]), -float(model.get_piece_size())
        else:
            key = piece.encode()
        known[key] = max(known.get(key, -math.inf), score)
    pieces = sorted(known)
    p = 1.0 / (OFFSET - np.array([known[k] for k in pieces]))
    p *= 0.75 / p.sum()
    return pieces, np.log(np.append(p, 0.25))


def _words(column: pa.Array):
    """(first row, rows, bytes, starts, ends, hashes, row of each word) of chunks of a text column."""
    for a, b, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, counts = word_spans(data, offsets)
        yield a, b - a, data, starts, ends, span_hashes(data, starts, ends), np.repeat(np.arange(b - a), counts)


def _types(classes: int):
    """Distinct words of a task with their training counts by class (held-back words: 0)."""

    def merge(parts):
        h = np.concatenate([p[0] for p in parts])
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        counts = np.stack([np.bincount(back, np.concatenate([p[2][k] for p in parts]), minlength=len(key)) for k in range(classes)])
        return key, pa.concat_arrays([p[1] for p in parts]).take(pa.array(first)), counts

    def batch_of(part):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part[0]) + 1, dtype=np.int32) * classes), pa.array(part[2].T.astype(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), part[1], lists], ["h", "word", "c"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for a, _, data, starts, ends, h, row in _words(batch.column("text")):
                key, first, back = np.unique(h, return_index=True, return_inverse=True)
                counts = np.zeros((classes, len(key)))
                train = ~held[a + row]
                for k in range(classes):
                    counts[k] = np.bincount(back[train & (cls[a + row] == k)], minlength=len(key))
                s, e = starts[first], ends[first]
                at = np.append(0, np.cumsum(e - s))
                if at[-1] >= 2**31:
                    raise ValueError("words of over 2 GB in one chunk")
                held_bytes = pa.py_buffer(data[ragged(s, e - s)].tobytes())
                parts.append((key, pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(at.astype(np.int32)), held_bytes]), counts))
                size += len(key)
                if size > _FLUSH:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size > _FLUSH // 2:
                        yield batch_of(parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(merge(parts))

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _gathered(batches):
    """Batches of about _GATHER rows, so that many words of one size meet."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _expect(pieces, logs):
    def run(batches):
        lattice, counts = Lattice(pieces), np.zeros_like(logs)
        for batch in _gathered(batches):
            word, cls = np.nonzero(_matrix(batch.column("c")) > 0)
            lattice.run(batch.column("word").take(pa.array(word)).to_pylist(), logs, counts, cls)
        for k, x in enumerate(counts):
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(x[used])], ["k", "piece", "x"])

    return run


def _weigh(pieces, logs):
    def run(batches):
        lattice = Lattice(pieces)
        for batch in _gathered(batches):
            p = lattice.run(batch.column("word").to_pylist(), logs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(logs)), pa.array(p.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), lists], ["h", "c", "lattice"])

    return run


def _sum_head(head: np.ndarray, logs: np.ndarray, end: np.ndarray):
    """Rows of two kinds: a document's sums over its head words and end (row, counts, sums), and its other words (row, h, n)."""
    slots = 1 << max(10, (4 * len(head)).bit_length())
    at = np.full(slots, -1, np.int32)
    at[(mix(head) & np.uint64(slots - 1)).astype(np.int64)[::-1]] = np.arange(len(head), dtype=np.int32)[::-1]

    def run(batches):
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for a, n, _, _, _, h, row in _words(batch.column("text")):
                k = at[(mix(h) & np.uint64(slots - 1)).astype(np.int64)]
                hit = (k >= 0) & (head[k] == h) if len(head) else np.zeros(len(h), bool)
                sums = np.stack([np.bincount(row[hit], column[k[hit]], minlength=n) for column in logs]) + end[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(end)), pa.array(sums.T.ravel()))
                size = np.bincount(row, minlength=n) + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + n]), pa.nulls(n, pa.int64()), pa.array(size), lists], ["row", "h", "n", "sums"])
                miss = np.flatnonzero(~hit)
                order = miss[np.lexsort((h[miss], row[miss]))]
                new = np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row[order[first]]]), pa.array(h[order[first]].view(np.int64)), pa.array(np.diff(np.append(first, len(order)))), pa.nulls(len(first), pa.list_(pa.float64()))], ["row", "h", "n", "sums"])

    return run


def score(docs: DataFrame, model: str, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for each row of docs (doc_id, text, lang, held).

    model: the path of a sentencepiece vocabulary with scores, the same on all machines. base_score: add-0.1 unigrams.
    lattice_score: log10 of the text's probability by the vocabulary's own weights alone, with nothing learned.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col("held"), F.lit(False))
    langs = [r["lang"] for r in docs.filter(~held).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES + 1).collect()]
    named = [x for x in langs if x is not None][:CLASSES]
    cls = F.lit(len(named))
    for k, lang in enumerate(named):
        cls = F.when(F.col("lang") == lang, k).otherwise(cls)
    classes = max(1, len(named) + (len(langs) > len(named)))
    texts = docs.select(F.col("doc_id"), "text", cls.cast("int").alias("cls"), held.alias("held"))
    found = texts.select("text", "cls", "held").mapInArrow(_types(classes), "h long, word binary, c array<long>")
    parts = found.select("h", "word", *[F.col("c")[k].alias(f"c{k}") for k in range(classes)])
    types = parts.groupBy("h").agg(F.min("word").alias("word"), F.array(*[F.sum(f"c{k}") for k in range(classes)]).alias("c"))
    types = table(types, "types")
    n = F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b)
    trained = types.filter(n > 0)

    pieces, log_p = vocabulary(model)
    pieces_logs = np.tile(log_p, (classes, 1))
    for _ in range(rounds):
        counts = np.full_like(pieces_logs, 0.01)
        expected = trained.select("word", "c").mapInArrow(_expect(pieces, pieces_logs), "k long, piece long, x double").groupBy("k", "piece").agg(F.sum("x").alias("x"))
        for r in expected.collect():  # classes times pieces at most
            counts[r["k"], r["piece"]] += r["x"]
        pieces_logs = np.log(counts / counts.sum(1, keepdims=True))
    weighed = table(types.select("h", "word", "c").mapInArrow(_weigh(pieces, np.vstack([pieces_logs, log_p])), "h long, c array<long>, lattice array<double>"), "weighed")

    ends = {r["cls"]: r["n"] for r in texts.filter("not held").groupBy("cls").agg(F.count("*").alias("n")).collect()}
    end = np.array([ends.get(k, 0) for k in range(classes)], float)
    stats = [F.sum(v.cast("long")).alias(f"{name}{k}") for k in range(classes + 1) for c in [F.col("c")[k] if k < classes else n] for name, v in (("n", c), ("v", c > 0), ("one", c == 1), ("two", c == 2))]
    found = weighed.agg(*stats).first().asDict()
    each = np.append(end, end.sum())
    total = np.array([found[f"n{k}"] or 0 for k in range(classes + 1)], float) + each
    kinds = np.array([found[f"v{k}"] or 0 for k in range(classes + 1)], float) + (each > 0)
    one, two = (np.array([found[f"{x}{k}"] or 0 for k in range(classes + 1)], float) + (each == w) for x, w in (("one", 1), ("two", 2)))
    cut = np.where((one > 0) & (two > 0), one / np.maximum(one + 2 * two, 1), 0.5)
    all_tokens, all_kinds = total[-1], kinds[-1]

    def parts_of(k, c, n, greatest):
        """(known, open): a word's probability in class k is known + open * base, from its counts in the class and in all."""
        all_known, all_open = (greatest(n - float(cut[-1]), 0.0) / float(total[-1]), cut[-1] * kinds[-1] / total[-1]) if total[-1] else (c * 0.0, 1.0)
        own_known, own_open = (greatest(c - float(cut[k]), 0.0) / float(total[k]), cut[k] * kinds[k] / total[k]) if total[k] else (c * 0.0, 1.0)
        return own_known + all_known * float(own_open * POOLED), float(own_open * (1 - POOLED + POOLED * all_open))

    values = []
    for k in range(classes):
        sure, rest = parts_of(k, F.col("c")[k], n, lambda x, y: F.greatest(x, F.lit(y)))
        base = F.col("lattice")[k] + math.log(1 - END)  # END of the base is the end's
        values.append(F.when(sure > 0, F.log(sure + F.exp(base) * rest)).otherwise(base + math.log(rest)))
    plain = F.log10((n + 0.1) / F.lit(all_tokens + 0.1 * (all_kinds + 1)))
    known = table(weighed.select("h", n.alias("n_train"), F.array(*values, plain, (n > 0).cast("double"), F.col("lattice")[classes] + math.log(1 - END)).alias("logs")), "known")
    end_parts = [parts_of(k, end[k], end.sum(), max) for k in range(classes)]
    end_logs = np.array([*(math.log(sure + rest * END) for sure, rest in end_parts), math.log10((end.sum() + 0.1) / (all_tokens + 0.1 * (all_kinds + 1))), float(end.sum() > 0), math.log(END)])
    level = F.floor(F.log2("n_train") * 16)
    least, room = None, head
    for r in known.filter("n_train > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # levels of a count: 1,024 at most
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    heads = known.filter(F.lit(False) if least is None else (F.col("n_train") > 0) & (level >= least))
    top = heads.select("h", "logs").toArrow()  # bounded by the parameter
    head_h = top.column("h").to_numpy().view(np.uint64)
    head_logs = np.ascontiguousarray(top.column("logs").combine_chunks().flatten().to_numpy().reshape(len(head_h), -1).T) if len(head_h) else np.zeros((classes + 3, 0))

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    names = table(numbered.select("row", "doc_id", "held"), "rows")
    both = table(numbered.select("row", "text").mapInArrow(_sum_head(head_h, head_logs, end_logs), "row long, h long, n long, sums array<double>"), "sums")
    rare = both.filter("h is not null").select("row", "h", "n").join(known.select("h", "logs"), "h")
    rare = rare.groupBy("row").agg(*[F.sum(F.col("n") * F.col("logs")[k]).alias(f"s{k}") for k in range(classes + 3)])
    whole = both.filter("h is null").select("row", F.col("n").alias("n_tokens"), "sums").join(rare, "row", "left")
    s = [F.col("sums")[k] + F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(classes + 3)]
    share = (end + 1e-9) / (end + 1e-9).sum()
    joint = [s[k] + math.log(share[k]) for k in range(classes)]
    most = F.greatest(*joint) if classes > 1 else joint[0]
    total_p = most + F.log(sum((F.exp(j - most) for j in joint), F.lit(0.0)))
    out = whole.join(names, "row")
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", F.round(s[classes + 1]).cast("long").alias("n_known"), F.lit(int(all_tokens)).cast("long").alias("train_tokens"), s[classes].alias("base_score"), (total_p / math.log(10)).alias("score"), (s[classes + 2] / math.log(10)).alias("lattice_score"))
