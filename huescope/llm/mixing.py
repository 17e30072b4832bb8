"""Mixing of sources to target weights, by blocks of words.

Each source's texts, in doc_id order, are one stream of words cut into blocks of fixed length. Sources
get targets in words by weight; a source's target fills a number of slots, which are dealt to output
shards by a multinomial draw (each slot draws its shard, so the counts of a source over the shards are
multinomial while its total is exact). Slot i of a source takes block p_e(i mod n), where n is its
number of blocks, e = i div n the pass over them and p_e a pseudorandom permutation of the full blocks keyed by source,
pass and seed; a last block that isn't full ends each pass, so that the words taken add up to the target exactly. Slots and blocks meet in a join on (source, block): every key has one block and at most
two slots, so no key is hot. Reruns agree: nothing depends on partitions but the order of rows that
agree in doc_id, which are ordered by their text. Only the sources' own totals, a row each, are brought together in one task.

Nulls: a null text is empty; a null source is a source of its own, last in order; a null doc_id is
ordered first. Without words nothing is taken, and an empty table gives no rows. Very long texts are cut into as many blocks as they fill. Repeated rows are
rows of their own. Other columns, whatever their names, are neither read nor confused with ours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .offsets import running_start
from .shared import table
from .spans import chunks, lean, mix, word_spans

BLOCK, SHARDS, SEED = 256, 64, 20
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
_CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text; 0 of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size: a row each) with source_no and target, in words.

    Weights repeat over the sources by code point, null last. share times all words are shared by weight;
    no target passes most times its source's size, the excess is shared by weight among the others.
    That is the level L at which the sum of min(weight * L, most * size) is what is shared.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumns({"_w": F.element_at(cycle, F.col("source_no") % len(weights) + 1), "_cap": F.col("source_size") * F.lit(float(most))})
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    earlier, later = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(later))
    free = F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level"))
    ranked = ranked.withColumn("_at", F.max(free).over(everything))
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_at")))
    return ranked.select("source", "source_no", "source_size", target.alias("target"))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """p(x) for pseudorandom permutations p of 0 .. n-1 keyed by key: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(left):
        m, h, k, v = mask[left], half[left], key[left], out[left]
        a, b = v >> h, v & m
        for r in range(4):
            a, b = b, a ^ (mix(b + k, r + 1) & m)
        out[left] = v = (a << h) | b
        left = left[v >= n[left].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(block: int, shards: int, seed: int):
    @lean
    def run(batches):
        for batch in batches:
            no, i, n, full = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source_no", "slot", "blocks", "full"))
            turn = i // np.maximum(n, 1)
            key = mix(mix(no.astype(np.uint64), seed) + turn.astype(np.uint64), seed)
            place = i - turn * n
            to = np.where(place < full, permuted(np.minimum(place, np.maximum(full - 1, 0)), np.maximum(full, 1), key), place)
            shard = (mix(mix(no.astype(np.uint64), seed + 1) + i.astype(np.uint64), seed + 1) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(to), pa.array(i), pa.array(turn), pa.array(shard), batch.column("take")], ["source_no", "block", "slot", "turn", "shard", "take"])

    return run


def mix_plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shards=SHARDS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, taken). rows: row_no, doc_id, tie (of the text), size, source, source_size, source_no, target; taken: row_no, source_no, turn,
    slot, shard, first, last: words first .. last-1 of that row fill a part of that slot. Texts are read once and not carried on."""
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    base = table(docs.select("doc_id", "source", tie.alias("tie"), word_count(F.col("text")).alias("size")), "sizes")
    placed = running_start(base, [F.col("doc_id"), F.col("tie")], "size", "start", group="source")
    placed = table(placed.withColumn("row_no", F.monotonically_increasing_id()), "placed")
    goals = table(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "goals")
    rows = placed.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    b = F.lit(block)
    want = F.floor(F.col("target") + 0.5)
    plan = goals.filter("source_size > 0").select("source_no", F.ceil(F.col("source_size") / b).alias("blocks"), F.floor(F.col("source_size") / b).alias("full"), F.floor(want / F.col("source_size")).alias("turns"), (want % F.col("source_size")).alias("rest"))
    plan = plan.withColumn("n", F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / b)).filter("n > 0")
    parts = plan.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _CHUNK).cast("long")))).repartition("source_no", "c")
    slots = parts.withColumn("slot", F.explode(F.sequence(F.col("c") * _CHUNK, F.least((F.col("c") + 1) * _CHUNK, F.col("n")) - 1)))
    left = F.col("rest") - (F.col("slot") - F.col("turns") * F.col("blocks")) * b
    take = F.when(F.col("slot") < F.col("turns") * F.col("blocks"), b).otherwise(F.least(b.cast("long"), left)).cast("long")
    slots = slots.select("source_no", "slot", "blocks", "full", take.alias("take"))
    dealt = slots.mapInArrow(_slots(block, shards, seed), "source_no int, block long, slot long, turn long, shard long, take long")
    whole = rows.filter("size > 0").select("row_no", "source_no", "start", "size")
    pieces = whole.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    inside = F.col("block") * b - F.col("start")  # the block's first word, counted in the row
    met = pieces.join(dealt.hint("merge"), ["source_no", "block"])  # both sides grow with the input
    taken = met.select("row_no", "source_no", "turn", "slot", "shard", F.greatest(F.lit(0), inside).alias("first"), F.least(F.col("size"), inside + F.col("take")).alias("last"))
    return rows, taken.filter("last > first")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards (the output shards that its words go to) for each row."""
    rows, taken = mix_plan(docs, **options)
    sums = taken.groupBy("row_no").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"))
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")]
    return rows.join(sums.hint("merge"), "row_no", "left").select("doc_id", "size", "source_size", "target", *counted)


def _passages(columns: list[str], more: list[str], merged: bool):
    """Rows of `columns` (c0, c1, ... in their order) with each run of words in `runs` as the text, white space inside it as it was.
    merged: runs that touch are one passage; one of all words is the whole text."""
    place = columns.index("text")

    @lean
    def run(batches):
        for batch in batches:
            texts, runs = batch.column(f"c{place}"), batch.column("runs").to_pylist()
            for a, b, data, offsets in chunks(texts):
                starts, ends, counts = word_spans(data, offsets)
                at, raw = np.append(0, np.cumsum(counts)).tolist(), data.tobytes()
                row, text, fields = [], [], []
                for i in range(a, b):
                    found: list = []
                    for r in sorted(runs[i], key=lambda r: (r["first"], r["last"])):
                        if merged and found and found[-1]["last"] == r["first"]:
                            found[-1] = {**found[-1], "last": r["last"]}
                        else:
                            found.append(r)
                    for r in found:
                        x, y = int(starts[at[i - a] + r["first"]]), int(ends[at[i - a] + r["last"] - 1])
                        if merged and r["last"] - r["first"] == counts[i - a]:
                            x, y = int(offsets[i - a]), int(offsets[i - a + 1])
                        row.append(i)
                        text.append(raw[x:y])
                        fields.append(r)
                for k in range(0, len(row), 1000):
                    index, own = pa.array(row[k : k + 1000], pa.int64()), pa.array(text[k : k + 1000], pa.binary()).cast(pa.string())
                    out = [own if c == "text" else batch.column(f"c{j}").take(index) for j, c in enumerate(columns)]
                    if "n_chars" in columns:
                        j = columns.index("n_chars")
                        out[j] = pa.compute.utf8_length(own).cast(batch.column(f"c{j}").type)
                    out += [pa.array([f[m] for f in fields[k : k + 1000]], pa.int64()) for m in more]
                    yield pa.RecordBatch.from_arrays(out, [*columns, *more])

    return run


def _texts(docs: DataFrame, rows: DataFrame, taken: DataFrame, by: list[str]) -> DataFrame:
    """c0, c1, ... (the columns of docs) and runs, for each row that is taken and each value of `by`. Rows that agree in doc_id, source and text are
    told apart by a number: the plan's by row_no, those of docs by a hash of all columns."""
    runs = taken.groupBy("row_no", *by).agg(F.collect_list(F.struct("first", "last", "source_no", "slot", "shard")).alias("runs"))
    tie, names = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), [f"c{j}" for j in range(len(docs.columns))]
    own = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.struct("doc_id", "source", tie.alias("tie")).alias("key"))
    planned = rows.filter("size > 0").select("row_no", F.struct("doc_id", "source", "tie").alias("key"))
    again = planned.groupBy("key").count().filter("count > 1").select("key")
    if again.isEmpty():
        return planned.join(runs.hint("merge"), "row_no").select("key", "runs").join(own, "key").drop("key")

    def numbered(df: DataFrame, order: Column) -> DataFrame:
        """df with `n`: 0 where its key stands alone, else its place among the rows of its key."""
        several = running_start(df.join(again, "key", "left_semi").withColumn("one", F.lit(1)), [order], "one", "n", group="key").drop("one")
        return df.join(again, "key", "left_anti").withColumn("n", F.lit(0).cast("long")).unionByName(several)

    keyed = numbered(planned, F.col("row_no")).join(runs.hint("merge"), "row_no").select("key", "n", "runs")
    return keyed.join(numbered(own, F.xxhash64(F.to_json(F.struct(*names)))), ["key", "n"]).drop("key", "n")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of docs: each pass over a row gives a row for each passage that it takes, a run of words of blocks that touch,
    as it stands in the text; a pass that takes all words gives the text as it is. n_chars, where there is one, is the passage's."""
    rows, taken = mix_plan(docs, **options)
    return _texts(docs, rows, taken, ["turn"]).mapInArrow(_passages(docs.columns, [], True), docs.schema)


def mix_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix as blocks of fixed length dealt to output shards: shard, source_no, slot, doc_id, text, first, last.

    The rows of one (source_no, slot) are a block's passages, in doc_id order and in order of first within a text; their words are block many,
    fewer in the block that ends a pass or the mix. Write with partitionBy("shard").
    """
    rows, taken = mix_plan(docs, **options)
    own = docs.select("doc_id", "source", "text")
    more = ["first", "last", "source_no", "slot", "shard"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _texts(own, rows, taken, ["turn"]).mapInArrow(_passages(own.columns, more, False), f"doc_id {kind}, source string, text string, first long, last long, source_no long, slot long, shard long")
    return cut.select("shard", "source_no", "slot", "doc_id", "text", "first", "last")
