"""Near-duplicate documents: fast similarity sketches, banding, exact verification on whole shingle sets.

A document's set holds the hashes (64 bits) of its distinct runs of `width` words, A-Z lower-cased; with fewer
words the whole sequence is the one element. Documents of equal sets are one class from then on, so copies are
never paired. A sketch has T coordinates, filled in rounds: in round i every element is placed in a bin by a hash,
with (i, hash) as its value; a bin keeps its least value, so the first round that reaches a bin decides. After T
rounds a further round for each bin places every element there: all coordinates are filled whatever the
set's size, and each agrees between two sets with their Jaccard similarity as probability, with concentration as
of independent ones. ROWS coordinates make a band; a pair at similarity 0.8 shares none of the BANDS with
probability 5e-6.

Buckets are not paired off. First the buckets of FIRST bands compare their members with one pivot each, the one whose
buckets hold most rows, which is what the others were copied from; links are confirmed on the full sets and make components. Then, of all bands,
only buckets that hold several components are looked at: members outside a bucket's largest component are compared with the member of it that met most
at first, then with any other, and components are brought up to date. Members of buckets that are still open
meet by their rarest shingles instead of in pairs: each set's prefix, in an order from rare to frequent, holds an
element of every similar set (see _by_prefix). Those around one large component meet by their rarest differences from what most of
them hold, so a group of near copies isn't paired off either (see _from_core). Only pairs whose connection is already proven or that can't be similar are never
looked at, so components are those of all links that share a bucket.

Very long texts have as long sets, a pair of which is compared in one task; a chunk of texts has one long text at most. Nulls: a null or empty text, or one without words, has an empty set, is linked with nothing and kept. A null
doc_id counts after all others. Rows that repeat a doc_id are rows of their own. Columns other than doc_id and
text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import collected, drop, table, whole_row
from .spans import LOWER, chunks, lean, mix, span_hashes, word_spans

WIDTH, SIMILARITY = 5, 80
ROWS, BANDS = 6, 40
T = ROWS * BANDS
TURNS, FIRST = 3, 8
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_SEEDS = mix(np.arange(2 * T, dtype=np.uint64), 31)
_COEF = mix(np.arange(ROWS, dtype=np.uint64), 32) | _U(1)
_BAND = mix(np.arange(BANDS, dtype=np.uint64), 33)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = len(words)
    run = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        run = run * _STEP + words[k : k + len(run)]
    run = mix(run)
    at = np.append(0, np.cumsum(counts)).tolist()
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            whole = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _STEP + w
            out.append(mix(np.array([whole], np.uint64), 7))
        else:
            out.append(run[:0])
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty: (round, hash) packed, equal for equal elements only."""
    bins = np.full(T, 2**64 - 1, np.uint64)
    at, each = 0, max(1, 2048 // len(s))
    while at < T:
        r = np.arange(at, min(T, at + each), dtype=np.uint64)
        h = mix(s[None, :] ^ _SEEDS[at : at + len(r), None])
        np.minimum.at(bins, (h % _U(T)).astype(np.int64).ravel(), ((r[:, None] << _U(53)) | (h >> _U(11))).ravel())
        at += len(r)
        if bins.max() != 2**64 - 1:
            return bins
    left = np.flatnonzero(bins == 2**64 - 1)
    for b in left.tolist():
        bins[b] = (_U(T + b) << _U(53)) | (mix(s ^ _SEEDS[T + b]).min() >> _U(11))
    return bins


def _sketches(width: int):
    @lean
    def run(batches):
        for batch in batches:
            ids, tie = batch.column("doc_id"), batch.column("tie")
            for a, b, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                keys, first, second = [], [], []
                for s in sets:
                    first.append(int(mix(s, 1).sum().view(np.int64)) if len(s) else 0)
                    second.append(int(np.bitwise_xor.reduce(mix(s, 2)).view(np.int64)) if len(s) else 0)
                    keys.append(mix((sketch(s).reshape(BANDS, ROWS) * _COEF).sum(1) + _BAND).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tie.slice(a, b - a), pa.array(size), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tie", "n", "h1", "h2", "bands"])

    return run


def _sets(width: int):
    @lean
    def run(batches):
        for batch in batches:
            node, h1, h2 = (batch.column(c).to_numpy() for c in ("node", "h1", "h2"))
            for a, b, data, offsets in chunks(batch.column("text")):
                keep, held = [], []
                for i, s in enumerate(shingle_sets(data, offsets, width), a):
                    if len(s) and int(mix(s, 1).sum().view(np.int64)) == h1[i] and int(np.bitwise_xor.reduce(mix(s, 2)).view(np.int64)) == h2[i]:
                        keep.append(node[i])
                        held.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(held, pa.binary())], ["node", "set"])

    return run


def _linked(similarity: int):
    @lean
    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):  # a pair at a time: sets are as long as their texts
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * shared >= similarity * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def _fits(x: str, y: str, similarity: int):
    """Whether sets of such sizes can be similar enough."""
    return 100 * F.least(x, y) >= similarity * F.greatest(x, y)


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


@lean
def _elements(batches):
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column("set")).to_numpy())
        kept = [c for c in batch.schema.names if c != "set"]
        a = 0
        while a < batch.num_rows:  # parts of bounded size, a longer set by itself
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), "right")))
            part = batch.slice(a, b - a)
            held = part.column("set").to_pylist()
            size = np.fromiter((len(x) // 8 for x in held), np.int64, len(held))
            row = pa.array(np.repeat(np.arange(len(held)), size))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in kept), pa.array(np.frombuffer(b"".join(held), np.int64))], [*kept, "s"])
            a = b


@lean
def _differences(batches):
    """The elements that only one of a set and its group's core holds, and their number; a set less similar to the core than a half gives no row."""
    for batch in batches:
        held, cores, row, apart = batch.column("set"), batch.column("core"), [], []
        for i in range(batch.num_rows):
            both = np.sort(np.concatenate([np.frombuffer(held[i].as_buffer(), np.uint64), cores[i].values.to_numpy().view(np.uint64)]))
            twice = both[1:] == both[:-1]
            once = both[~(np.append(False, twice) | np.append(twice, False))]
            if 3 * len(once) <= len(both):
                row.append(i)
                apart.append(once)
        kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("node", "root", "ref", "n")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in apart], pa.int64()), pa.array([x.tobytes() for x in apart], pa.binary())], ["node", "root", "ref", "n", "d", "set"])


def _by_prefix(nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(node, other): pairs of nodes (node, n, root, ref) that with the roots connect all similar ones.

    A set of n shares at least similarity * n / 100 elements with a similar one, so of its elements in an order common
    to all sets, one of the first n less that, plus one, is shared. The order has first the elements that one side alone has,
    which meet nothing, then the rarest; a long shared passage comes last and by itself brings nobody together.

    Near copies of one text share all but a few elements, so each would meet each. Nodes of one ref therefore meet by their
    differences from its core, the elements of more than half of its nodes (see _from_core), and only nodes of different refs by their elements.
    """
    both = nodes.join(sets, "node")
    groups = nodes.groupBy("ref").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("ref", "k")
    common = both.join(groups.select("ref"), "ref", "left_semi").select("ref", "set").mapInArrow(_elements, "ref long, s long").groupBy("ref", "s").agg(F.count("*").alias("c"))
    core = table(common.filter("c > 1").join(groups, "ref").filter("2 * c > k").groupBy("ref").agg(F.collect_list("s").alias("core")), "cores")
    apart = both.join(core, "ref").select("node", "root", "ref", "n", "set", "core")
    apart = table(apart.mapInArrow(_differences, "node long, root long, ref long, n long, d long, set binary"), "differences")
    sure, inner = _from_core(apart, similarity)
    side = F.when(F.col("near"), F.col("ref")).otherwise(-1 - F.col("root"))
    plain = both.join(apart.select("node", F.lit(True).alias("near")), "node", "left").withColumns({"side": side, "w": 2 * similarity * F.col("n"), "least": F.floor((F.col("n") * similarity + 99) / 100)})
    plain = plain.withColumn("ref", F.lit(-1).cast("long"))
    rows = [x.select("ref", "node", "root", "side", "n", F.col("w").cast("long").alias("w"), F.col("least").cast("long").alias("least"), "set") for x in (plain, inner)]
    held = table(rows[0].union(rows[1]).mapInArrow(_elements, "ref long, node long, root long, side long, n long, w long, least long, s long"), "elements")
    meets = held.groupBy("ref", "s").agg(F.count("*").alias("c"), F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo < hi").select("ref", "s", "c")
    met = held.join(meets, ["ref", "s"])
    place = F.row_number().over(Window.partitionBy("ref", "node").orderBy("c", "s"))
    ranked = met.withColumns({"place": place, "m": F.count("*").over(Window.partitionBy("ref", "node"))})
    first = ranked.filter(F.col("place") <= F.col("m") - F.col("least") + 1)
    first = table(first.select("ref", "node", "root", "side", "n", "w", "s", (F.col("m") - F.col("place") + 1).alias("rest")), "prefixes")
    other = first.select("ref", "s", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("side").alias("other_side"), F.col("n").alias("k"), F.col("w").alias("other_w"), F.col("rest").alias("other_rest"))
    enough = 2 * (100 + similarity) * F.least("rest", "other_rest") >= F.col("w") + F.col("other_w")  # if s is the first shared one, no more than these are
    pairs = first.join(other, ["ref", "s"]).filter("node < other and root != other_root and side != other_side")
    return pairs.filter(enough & _fits("n", "k", similarity)).select("node", "other").union(sure)


def _from_core(apart: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """((node, other): links that need no search; apart with side, w and least): from each set's d differences from its ref's core.

    Sets x, y with i differences in common are d + d' - 2 * i elements apart, so they are similar if and only if
    2 * (100 + similarity) * i >= w + w', where w = (100 + similarity) * d - (100 - similarity) * n. Where w + w' <= 0 they are similar
    without any in common; then both are so to the centre, the node of least w, too. Whoever is goes to the centre's side
    with its component. All others need differences in common: at least those asked by the least w on other sides.
    """
    apart = apart.withColumn("w", (100 + similarity) * F.col("d") - (100 - similarity) * F.col("n"))
    centre = apart.groupBy("ref").agg(F.min(F.struct("w", "node", "root")).alias("b")).select("ref", F.col("b.w").alias("low"), F.col("b.node").alias("centre"), F.col("b.root").alias("home"))
    centred = apart.join(centre, "ref")
    sure = centred.filter("w + low <= 0 and root != home").select("node", F.col("centre").alias("other"))
    joined = apart.groupBy("ref", "root").agg(F.min("w").alias("w")).join(centre, "ref").filter("w + low <= 0 or root = home").select("ref", "root", F.col("home").alias("side"))
    sided = centred.join(joined, ["ref", "root"], "left").withColumn("side", F.coalesce("side", "root"))
    others = sided.filter("side != home").groupBy("ref").agg(F.min("w").alias("far"))
    least = F.ceil((F.col("w") + F.when(F.col("side") == F.col("home"), F.col("far")).otherwise(F.col("low"))) / (2 * (100 + similarity)))
    return sure, sided.join(others, "ref").withColumn("least", least).filter("d >= least")


def classes_and_roots(docs: DataFrame, width: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, tie, n, h1, h2; classes: node, n, h1, h2, first_id; roots: node, root of the linked ones), tables all; others that were made on the way are gone."""
    with collected() as made:
        kept = _classes_and_roots(docs, width, similarity)
    drop(*[t for t in made if all(t is not k for k in kept)])
    rows, classes, roots = kept
    return rows.drop("bands"), classes.drop("bands"), roots


def _classes_and_roots(docs: DataFrame, width: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text"))
    rows = table(texts.mapInArrow(_sketches(width), "doc_id long, tie long, n long, h1 long, h2 long, bands array<long>"), "sketches")
    same = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    classes = table(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots, tested, sets = None, None, None

    def fetch(nodes: DataFrame) -> None:
        """Add the sets of those of these nodes that have none yet, in one pass over the texts."""
        nonlocal sets
        nodes = table((nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti")).distinct(), "wanted")
        if sets is not None and nodes.isEmpty():
            return
        wanted = classes.join(nodes, "node").select("first_id", "node", "h1", "h2")
        found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "h1", "h2", "text")
        new = table(found.mapInArrow(_sets(width), "node long, set binary").groupBy("node").agg(F.first("set").alias("set")), "sets", codec="uncompressed")
        sets = new if sets is None else sets.union(new)

    def confirm(pairs: DataFrame) -> bool:
        """Confirm links among pairs (node, other) of similar sizes and bring roots up to date; whether there were any."""
        nonlocal roots, tested
        pairs = pairs.filter("node != other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        half = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        whole = half.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        new = table(whole.mapInArrow(_linked(similarity), "a long, b long"), "links")
        if roots is None:
            roots = table(components(new), "roots")
            return not new.isEmpty()
        if new.isEmpty():
            return False
        for end in ("a", "b"):  # links between components known so far: few, and they need few rounds
            new = new.join(roots.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        moved = table(components(new), "moved")
        kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = table(kept.union(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")
        return True

    def sized(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets' sizes can be similar enough."""
        size = classes.select("node", "n")
        both = pairs.join(size, "node").join(size.select(F.col("node").alias("other"), F.col("n").alias("m")), "other")
        return both.filter(_fits("n", "m", similarity)).select("node", "other")

    banded = classes.select("node", F.explode(F.slice("bands", 1, FIRST)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = table(banded.join(shared, "key"), "buckets")
    degree = table(members.groupBy("node").agg(F.sum("c").alias("degree")), "degrees")
    pivot = members.join(degree, "node").groupBy("key").agg(F.min(F.struct(-F.col("degree"), "node")).alias("p"))
    confirm(sized(members.join(pivot, "key").select("node", F.col("p.node").alias("other")).filter("node != other").distinct()))

    # of all bands, buckets that hold several components: who is outside the largest one. A component's rank is a
    # number that is less for a greater one (by powers of two) and has its root in the low bits, below 2 ** 56
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    less = 63 - F.floor(F.log2(F.coalesce("size", F.lit(1)))).cast("long")
    named = _rooted(classes.select("node", "bands"), roots).join(size, "root", "left")
    named = table(named.select("node", (F.shiftleft(less, 56) + F.col("root")).alias("rank"), "bands"), "named")
    every = named.select("node", "rank", F.explode("bands").alias("key"))
    still = every.groupBy("key").agg(F.min("rank").alias("main"), F.max("rank").alias("last"))
    still = table(still.filter("main < last").select("key", "main"), "open")
    outside = every.join(still, "key").filter("rank > main").select("key", "node", F.col("main").bitwiseAND(F.lit(2**56 - 1)).alias("main"))
    outside = table(outside, "outside")
    for turn in range(TURNS):  # the largest component's member that met most at first, then any other
        central = F.struct(F.xxhash64("node", F.lit(turn)) if turn else -F.coalesce("degree", F.lit(0)), "node")
        member = _rooted(outside.select(F.col("main").alias("root")).distinct().join(roots, "root", "left").select(F.coalesce("node", "root").alias("node")), roots)
        member = member.join(degree, "node", "left").groupBy("root").agg(F.min(central).alias("p"))
        pairs = outside.select("node", "main").distinct().join(member.select(F.col("root").alias("main"), F.col("p.node").alias("other")), "main")
        pairs = table(pairs.select("node", "other"), "meetings")
        if not turn:  # all of them at once, whether or not these pairs are similar
            fetch(pairs.select(F.explode(F.array("node", "other")).alias("node")))
        confirm(sized(pairs))
        now = roots.select("node", F.col("root").alias("r"))
        moved = outside.join(now, "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
        moved = moved.join(now.withColumnRenamed("node", "main"), "main", "left").withColumn("now", F.coalesce("r", "main")).drop("r")
        outside = table(moved.filter("root != now").select("key", "node", F.col("now").alias("main")), "outside")
        if outside.isEmpty():
            break
    else:
        keys = outside.select("key").distinct()
        last = classes.select("node", "n", F.explode("bands").alias("key")).join(keys, "key", "left_semi").select("node", "n").distinct()
        # a component's ref: the largest among itself and those that it met in a bucket
        size = roots.groupBy(F.col("root").alias("main")).agg(F.count("*").alias("size"))
        met = _rooted(outside.select("node", "main").distinct(), roots).select("root", "main").distinct()
        met = met.union(met.select("main", "root")).union(met.select("root", "root")).union(met.select("main", "main")).distinct().join(size, "main", "left")
        refs = met.groupBy("root").agg(F.max(F.struct(F.coalesce("size", F.lit(1)).alias("size"), "main")).alias("r")).select("root", F.col("r.main").alias("ref"))
        last = table(_rooted(last, roots).join(refs, "root", "left").select("node", "n", "root", F.coalesce("ref", "root").alias("ref")), "last")
        fetch(last.select("node"))
        confirm(_by_prefix(last, sets, similarity))
    return rows, classes, roots


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept; a row for each row of docs.

    Then tie (a hash of the text) and class (the component, null for empty sets), for callers that join rows.
    """
    rows, classes, roots = classes_and_roots(docs, width, similarity)
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(ids, "root").select("h1", "h2", "n", "component_id", F.col("root").alias("class"))
    out = rows.join(known, ["h1", "h2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tie", "class")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of least doc_id stays (ties: by the text's hash; of equal rows one).

    Rows with empty sets all stay. Columns of docs may have any names.
    """
    with collected() as made:
        near = near_duplicates(docs, width, similarity)
    found = table(near, "found")
    drop(*made)
    best = found.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tie")).alias("w"))
    best = table(best.select(F.col("w.doc_id").alias("id"), F.col("w.tie").alias("tie")).distinct(), "winners")
    empty = found.filter("class is null").select(F.col("doc_id").alias("id"), "tie").distinct()
    good = best.union(empty).distinct().toDF("good_id", "good_tie")
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    kept = own.join(good, F.col("id").eqNullSafe(F.col("good_id")) & (F.col("tie") == F.col("good_tie")), "left_semi")
    again = found.filter("class is not null").groupBy("doc_id", "tie").count().filter("count > 1")
    if not again.isEmpty():
        key = F.when(~F.coalesce("row.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.monotonically_increasing_id())
        kept = kept.withColumn("key", key).dropDuplicates(["id", "tie", "key"])
    return kept.select("row.*")
