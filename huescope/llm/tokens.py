"""Token ids of texts in a binary format: frequency-ranked ids, byte-aligned variable length, control bytes apart.

Encoding. Where the tokenizer splits bytes by its usual pattern, a text is cut at places where that pattern always
splits: before a white-space byte that stands alone between two others, and between ASCII letters, digits and marks other than the
apostrophe. The ids of the pieces, one after the other, are the ids of the text. Each piece is encoded by the tokenizers library once for as long
as a bounded, direct-mapped cache keeps it (its length with all its bytes, or 128 bits of hash of those over 16 bytes, tell pieces apart);
pieces go to the library in lines, many a call. Texts with white space beyond ASCII or an added token's string go to the library whole, and so do
all texts if the tokenizer splits otherwise. The end id closes every document.

Format. Ids are replaced by their rank by frequency over all documents (ties: the lower id first), so
that frequent ids take one byte. A payload is: magic "SVR1", the number of ids as 4 bytes little-endian,
control bytes (2 bits an id, low bits first: its length in bytes less one), then the ids' bytes, little-endian.
A file set is a Parquet table of shards in ascending doc_id order, one payload a document, beside a table of
ranks; Spark's committer writes it, so a lost executor's half-written part is never seen. Decoding is by numpy
tables: a control byte gives its four lengths at once.

Nulls: a null text is empty and has the end id alone; a null doc_id comes first; rows that agree in doc_id are
ordered by their ids' checksum. Very long texts are encoded whole, in a chunk of their own. Repeated rows are rows of their own; other columns, whatever
their names, aren't read; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table
from .spans import SPACE, chunks, lean, mix, ragged, span_hashes

END = 0
MAGIC = b"SVR1"
_SLOTS = 1 << 20
_POOL = 1 << 23
_SHORT, _LONGEST, _CALL = 16, 64, 5_000
_IDS = 1 << 20
_APOSTROPHE = 0x27
_CLASS = np.full(256, 4, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other visible ASCII, 4 beyond ASCII, 5 controls
_CLASS[[*range(0x20), 0x7F]] = 5
_CLASS[0x21:0x7F] = 3
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = 1
_CLASS[48:58] = 2
_CLASS[SPACE] = 0
_PLAIN = (_CLASS > 0) & (_CLASS < 4) & (np.arange(256) != _APOSTROPHE)


def words_of_eight(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the eight bytes from each place on, the eight bytes up to it) as numbers; zeros beyond either end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8 : 8 + len(data)] = data
    return (np.ndarray((len(data) + 1,), "<u8", padded.data, at, (1,)) for at in (8, 0))


class Encoder:
    """encode(bytes, offsets) -> (all ids, ids in each row), ids as the tokenizers library gives them."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        own = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.cuts = self.tokenizer.normalizer is None and own.get("type") == "ByteLevel" and own.get("use_regex") and not own.get("add_prefix_space")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.first, self.last = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.length, self.size, self.at = (np.zeros(_SLOTS, np.int32) for _ in range(3))
        self.pool = np.zeros(1 << 20, np.uint32)
        self.pool[0] = self.end
        self.used = 1

    def compact(self) -> None:
        """Leave the ids of pieces that lost their slot; should that not halve the pool, all."""
        live = np.flatnonzero(self.size)
        size = self.size[live].astype(np.int64)
        if 2 * size.sum() > _POOL:
            self.reset()
            return
        ids = self.pool[ragged(self.at[live].astype(np.int64), size)]
        self.at[live] = 1 + np.cumsum(size) - size
        self.used = 1 + len(ids)
        self.pool[1 : self.used] = ids

    def add(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces into the pool: where their ids begin, how many there are. Joined ones go to the library in lines,
        which it cuts at every line's end; their ids lie between those of the line ends."""
        size, found = np.zeros(len(starts), np.int64), []
        order = np.append(np.flatnonzero(joined), np.flatnonzero(~joined))
        n = int(joined.sum())
        pieces = [raw[x:y] for x, y in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
        for a in range(0, n, _CALL):
            lines = b"\n".join(pieces[a : min(a + _CALL, n)]).decode("utf-8", "replace") + "\n"
            ids = np.array(self.tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            stop = ids == self.line[0]
            size[order[a : min(a + _CALL, n)]] = np.diff(np.flatnonzero(stop), prepend=-1) - 1
            found.append(ids[~stop])
        if n < len(pieces):
            alone = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces[n:]], add_special_tokens=False)]
            size[order[n:]] = [len(x) for x in alone]
            found += [np.array(x, np.uint32) for x in alone]
        total = int(size.sum())
        if self.used + total > len(self.pool):
            grown = np.zeros(max(self.used + total, min(2 * len(self.pool), _POOL)), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        np.concatenate(found, out=self.pool[self.used : self.used + total])
        at = np.empty(len(starts), np.int64)
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        self.used += total
        return at, size

    def pieces(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all pieces and which can be a line among others."""
        n, kind = len(data), _CLASS[data]
        space = kind == 0
        cut = np.zeros(n + 1, bool)
        if self.cuts:
            solid = ~space & (kind != 5)
            cut[1 : n - 1] = space[1:-1] & solid[:-2] & solid[2:]
            plain = _PLAIN[data]
            cut[1:n] |= (kind[1:] != kind[:-1]) & plain[1:] & plain[:-1]
        cut[np.minimum(np.maximum(offsets[1:] - 1, 0), n)] &= ~space[np.minimum(np.maximum(offsets[1:] - 1, 0), n - 1)]  # a row's last byte
        whole = self.wide(data, offsets)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        for r in np.flatnonzero(whole):
            cut[offsets[r] : offsets[r + 1]] = False
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        spaces = np.append(0, np.cumsum(space))
        joined = (spaces[np.append(starts[1:], n)] - spaces[np.minimum(starts + 1, n)] == 0) & (data[starts] != 10) & (len(self.line) == 1) & bool(self.cuts)
        joined &= (np.append(starts[1:], n) - starts > 1) | ~space[starts]
        return starts, joined & ~whole[np.searchsorted(offsets, starts, "right") - 1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, n = len(offsets) - 1, len(data)
        if n == 0:
            return np.full(rows, self.end, np.uint32), np.ones(rows, np.int64)
        if self.used > _POOL:
            self.compact()
        raw = data.tobytes()
        starts, joined = self.pieces(data, offsets, raw)
        ends = np.append(starts[1:], n)
        length = ends - starts
        ahead, behind = words_of_eight(data)
        first, last = ahead[starts], behind[ends]  # up to sixteen bytes are known by them and the length
        few = length < 8
        first[few] &= (np.uint64(1) << (8 * length[few]).astype(np.uint64)) - np.uint64(1)
        last[few] = 0
        long = np.flatnonzero(length > _SHORT)
        if len(long):
            part = data[ragged(starts[long], length[long])]
            to = np.cumsum(length[long])
            first[long], last[long] = (span_hashes(part, to - length[long], to, which) for which in (0, 1))
        h = mix(first * np.uint64(0x9E3779B97F4A7C15) + last + length.astype(np.uint64))
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        hit = (self.first[slot] == first) & (self.last[slot] == last) & (self.length[slot] == length)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[one]
            for key in (first, last, length):
                if (key[miss] != key[new[back]]).any():  # two pieces of one hash: each by itself
                    new, back = miss, np.arange(len(miss))
            a, s = self.add(raw, starts[new], ends[new], joined[new])
            at[miss], size[miss] = a[back], s[back]
            keep = np.flatnonzero(length[new] <= _LONGEST)
            k = slot[new[keep]]
            self.first[k], self.last[k], self.length[k], self.at[k], self.size[k] = first[new[keep]], last[new[keep]], length[new[keep]], a[keep], s[keep]
        after = np.searchsorted(starts, offsets[1:])  # an end id follows the last piece of each row
        at, size = np.insert(at, after, 0), np.insert(size, after, 1)
        ids = self.pool[ragged(at, size)]
        total = np.append(0, np.cumsum(size))[after + np.arange(rows) + 1]
        return ids, np.diff(np.append(0, total))

    @staticmethod
    def wide(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
        lead = np.flatnonzero(_WIDE[data])
        out = np.zeros(len(offsets) - 1, bool)
        if len(lead):
            padded = np.append(data, (0, 0))
            one, two, three = data[lead], padded[lead + 1], padded[lead + 2]
            found = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
            found |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
            out[np.searchsorted(offsets, lead[found], "right") - 1] = True
        return out


_WIDE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
_encoders: dict[tuple[str, int], Encoder] = {}


def _encode(path: str, end: int) -> Callable:
    @lean
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, end) not in _encoders:
            _encoders[path, end] = Encoder(path, end)
        encoder = _encoders[path, end]
        for batch in batches:
            doc_id = batch.column("doc_id")
            for a, b, data, offsets in chunks(batch.column("text")):
                ids, counts = encoder.encode(data, offsets)
                raw, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts)) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                narrow = ids.astype("<u2") if len(ids) == 0 or ids.max() < 65536 else None
                kept, unit = (narrow.tobytes(), 2) if narrow is not None else (raw, 4)
                held = [kept[x:y] for x, y in zip((at[:-1] // 4 * unit).tolist(), (at[1:] // 4 * unit).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id.slice(a, b - a), pa.array(np.full(b - a, unit, np.int32)), pa.array(held, pa.binary()), pa.array(crc, pa.int64())], ["doc_id", "unit", "ids", "tie"])

    return run


def _joined(column: pa.Array, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of a column of binaries, ids in each); units: bytes an id in each."""
    held = column.to_pylist()
    size = np.fromiter(map(len, held), np.int64, len(held)) // units
    parts = [np.frombuffer(x, "<u2" if u == 2 else "<u4") for x, u in zip(held, units.tolist(), strict=True)] if (units != 2).any() else [np.frombuffer(b"".join(held), "<u2")]
    return np.concatenate([np.zeros(0, np.uint16), *parts]), size


def _parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes; a longer one stands alone."""
    ends = np.cumsum(pa.compute.binary_length(column).to_numpy())
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@lean
def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for a, b in _parts(batch.column("ids"), 2 * _IDS):
            ids, _ = _joined(batch.column("ids").slice(a, b - a), batch.column("unit").to_numpy()[a:b])
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of values, counts[i] of them each, as payloads of the format."""
    v = values.astype("<u4")
    length = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    groups = -(-counts // 4)
    code = np.zeros(int(groups.sum()) * 4, np.uint8)
    code[ragged((np.cumsum(groups) - groups) * 4, counts)] = length - 1
    control = (code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6).tobytes()
    body = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < length[:, None]].tobytes()
    c = np.append(0, np.cumsum(groups)).tolist()
    b = np.append(0, np.cumsum(length, dtype=np.int64))[np.append(0, np.cumsum(counts))].tolist()
    return [MAGIC + n.to_bytes(4, "little") + control[c[i] : c[i + 1]] + body[b[i] : b[i + 1]] for i, n in enumerate(counts.tolist())]


def pack(values: np.ndarray) -> bytes:
    """Values as one payload of the format."""
    return pack_all(values, np.array([len(values)]))[0]


_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def unpack_all(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the number in each) of payloads; pack_all's inverse. A payload that isn't of the format is an error."""
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    data = np.frombuffer(b"".join([*payloads, bytes(8)]), np.uint8)
    at = np.cumsum(size) - size
    if (size < 8).any() or (data[at[:, None] + np.arange(4)] != np.frombuffer(MAGIC, np.uint8)).any():
        raise ValueError("not a payload of this format")
    counts = (data[at[:, None] + np.arange(4, 8)].astype(np.int64) << np.arange(0, 32, 8)).sum(1)
    groups = -(-counts // 4)
    if (8 + groups > size).any():
        raise ValueError("the payload's length doesn't fit its control bytes")
    length = _LENGTHS[data[ragged(at + 8, groups)]].reshape(-1)[ragged((np.cumsum(groups) - groups) * 4, counts)]
    total = np.append(0, np.cumsum(length, dtype=np.int64))
    ends = np.cumsum(counts)
    before = total[ends - counts]
    if (total[ends] - before != size - 8 - groups).any():
        raise ValueError("the payload's length doesn't fit its control bytes")
    place = total[:-1] + np.repeat(at + 8 + groups - before, counts)
    value = data[place].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        more = np.flatnonzero(length > k)
        value[more] |= data[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value, counts


def unpack(payload: bytes) -> np.ndarray:
    """The values of a payload; pack's inverse."""
    return unpack_all([payload])[0]


def _pack(rank: np.ndarray) -> Callable:
    @lean
    def run(batches):
        for batch in batches:
            for a, b in _parts(batch.column("ids"), 2 * _IDS):
                part = batch.slice(a, b - a)
                ids, counts = _joined(part.column("ids"), part.column("unit").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pack_all(rank[ids], counts), pa.binary())], ["doc_id", "payload"])

    return run


def _read(ids_of: np.ndarray) -> Callable:
    @lean
    def run(batches):
        for batch in batches:
            for a, b in _parts(batch.column("payload"), _IDS):
                part = batch.slice(a, b - a)
                values, size = unpack_all(part.column("payload").to_pylist())
                raw, at = memoryview(ids_of[values].tobytes()), (np.append(0, np.cumsum(size)) * 4).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "shard", "row")), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    return run


def write_ids(docs: DataFrame, path: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Encode docs (doc_id, text) with the tokenizer file at path; (files, ranks) as read from what was written.

    files: shard, row (ascending in doc_id order, as the shards are), doc_id, payload. ranks: rank, id, n; as many as the vocabulary at most.
    """
    encoded = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_encode(path, end), "doc_id long, unit int, ids binary, tie long"), "ids")
    counts = encoded.select("unit", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(((r["id"], r["n"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))  # a vocabulary's ids at most
    rank = np.zeros(max((i for i, _ in found), default=0) + 1, np.uint32)
    for k, (i, _) in enumerate(found):
        rank[i] = k
    dealt = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")  # ranges are sampled from the written table
    packed = dealt.select("doc_id", "unit", "ids").mapInArrow(_pack(rank), "doc_id long, payload binary")
    files = table(packed.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("row"), "doc_id", "payload"), "token-shards", codec="uncompressed")
    ranks = docs.sparkSession.createDataFrame([(k, i, n) for k, (i, n) in enumerate(found)], "rank long, id long, n long")
    return files, table(ranks, "token-ranks")


def read_ids(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, shard, row, n_tokens, ids_crc32 for each document in the files."""
    known = {r["rank"]: r["id"] for r in ranks.collect()}  # a vocabulary's ids at most
    ids_of = np.array([known[k] for k in range(len(known))] or [0], np.uint32).astype("<u4")
    return files.select("doc_id", "shard", "row", "payload").mapInArrow(_read(ids_of), "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that write_ids() wrote.

    Shards follow each other in order, so a shard's first start is the sum over those before it: a row a shard is summed
    across tasks, the rest within each shard.
    """
    read = table(read_ids(*write_ids(docs, path, end)), "token-digests")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    firsts = read.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
