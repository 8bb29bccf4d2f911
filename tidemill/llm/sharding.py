"""Sharding by a k-d tree over document metadata.

A node that is to hold k shards is split at a weighted quantile (weights are
sizes) of its widest metadata dimension; the halves hold k // 2 and k - k // 2
shards.  Splitting stops at single shards, which are the leaves.  All nodes
of a level are split together.  Nodes, their extents and their medians are
tables: a median comes from a few passes of adding sizes in bins, each pass
zooming into the bin in which it lies.  The driver sees totals of the whole
table only, however many nodes there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, written

#: Bins of one pass over a node: the most rows of a node that are put in order by one task.
BINS = 1 << 16
#: Bits of the hash by which rows of equal metadata are told apart.
TIE_BITS = 32
#: Rows in one numbering group; the groups of a shard are numbered by prefix sums.
SLOT_ROWS = 20_000

#: Metadata dimensions, as whole numbers.
DIMENSIONS = {
    "words": "coalesce(length(text) - length(replace(text, ' ', '')) + 1, 0)",
    "wide_chars": "coalesce(octet_length(text) - length(text), 0)",
    "chars": "coalesce(length(text), 0)",
}


def _with_nodes(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Rows with what is known of their node.  Few nodes hold many rows each and are broadcast; many nodes hold few rows each and can be shuffled."""
    return rows.join(maybe_broadcast(nodes.withColumnRenamed("node", "_node"), n, BROADCAST_ROWS), F.col("node") == F.col("_node")).drop("_node")


def _passes(extent: int) -> int:
    """Passes until a span of so many values is down to one."""
    return max(1, math.ceil(math.log(extent + 1, BINS) - 1e-9))


def _zoom(rows: DataFrame, spans: DataFrame, n: int, passes: int) -> DataFrame:
    """Per node the value of the row at which the running weight, in order of value, reaches what is wanted.

    rows: node, size, v.  spans: node, lo, hi, before (weight below lo), want
    and other columns; it comes back with lo at the value and before below it.
    """
    other = [c for c in spans.columns if c not in ("lo", "hi", "before")]
    for _ in range(passes):
        stepped = spans.withColumn("step", F.expr(f"(hi - lo) div {BINS} + 1"))
        inside = _with_nodes(rows, stepped.select("node", "lo", "hi", "step"), n).where("v between lo and hi")
        weights = inside.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("size").alias("w"))
        running = weights.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        known = running.withColumnRenamed("node", "_node").join(maybe_broadcast(stepped, n, BROADCAST_ROWS), F.col("_node") == F.col("node"))
        found = known.where("before + upto >= want").groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("b")).withColumnRenamed("node", "_node")
        lo = F.col("lo") + F.col("b.bin") * F.col("step")
        spans = stepped.join(found, F.col("_node") == F.col("node"))
        spans = spans.select(*other, lo.alias("lo"), F.least("hi", lo + F.col("step") - 1).alias("hi"), (F.col("before") + F.col("b.upto") - F.col("b.w")).alias("before"))
        spans = written(spans, "kd-spans")
    return spans


def _split(meta: DataFrame, dims: list[str], whole: dict[str, int], n: int) -> DataFrame:
    """node, dim, cut, tie_cut of every open node."""
    extents = [f(d).alias(f"{m}_{d}") for d in dims for m, f in (("lo", F.min), ("hi", F.max))]
    found = meta.groupBy("node", "parts").agg(F.sum("size").alias("w"), *extents)
    # The widest dimension against its extent in the whole table; the first of equals.
    wide = [F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / max(1, whole[d])).alias("r"), F.lit(-i).alias("at"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for i, d in enumerate(dims)]
    best = found.withColumn("best", F.array_max(F.array(*wide)))
    want = F.col("w") * F.expr("parts div 2") / F.col("parts")
    spans = best.select("node", (-F.col("best.at")).alias("dim"), F.col("best.lo").alias("lo"), F.col("best.hi").alias("hi"), F.lit(0).cast("long").alias("before"), want.alias("want"))
    spans = written(spans, "kd-spans")
    place = F.array(*[F.col(d) for d in dims])
    valued = _with_nodes(meta.select("node", "size", "tie", place.alias("place")), spans.select("node", "dim"), n).select("node", "size", "tie", F.col("place")[F.col("dim")].alias("v"))
    cut = _zoom(valued.select("node", "size", "v"), spans, n, _passes(max(whole.values()) + 1))
    # Rows on the cut are divided by their tie hash.
    at_cut = _with_nodes(valued, cut.select("node", F.col("lo").alias("cut")), n).where("v = cut").select("node", "size", F.col("tie").alias("v"))
    ties = cut.select("node", "dim", "want", F.col("lo").alias("cut"), F.lit(0).cast("long").alias("lo"), F.lit((1 << TIE_BITS) - 1).alias("hi"), "before")
    return _zoom(at_cut, ties, n, _passes(1 << TIE_BITS)).select("node", "dim", "cut", F.col("lo").alias("tie_cut"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, str] | None = None) -> DataFrame:
    """Put every row into a shard; shards have near equal bytes.

    Give the number of shards, or the bytes that a shard should reach.  The
    size of a row is the UTF-8 bytes of its text (null: none) plus 1.  Rows
    with equal metadata are ordered by a hash of doc_id and text, so that
    ties, copies and a source that holds most rows split as evenly as others;
    rows that repeat both stay together.  Null text has zero metadata.  Empty
    input gives no rows.  Long texts weigh what they are and are not cut: a
    shard can be larger than its target by one row.  Columns that are no
    dimension are not read, whatever their names.

    Returns doc_id, size, text_crc32, shard, slot: slots count from 0 in each
    shard without gaps.
    """
    dims = dimensions or DIMENSIONS
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - TIE_BITS)
    meta = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            tie.alias("tie"),
            *[F.expr(f"cast({e} as long)").alias(d) for d, e in dims.items()],
        ),
        "kd-meta",
    )
    total = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    leaves = shards or max(1, math.ceil((total["w"] or 0) / target_bytes))
    whole = {d: total[d] or 0 for d in dims}
    # A node is known by its first shard; parts is into how many shards it is to be split.
    meta, place = meta.withColumn("node", F.lit(0).cast("long")).withColumn("parts", F.lit(leaves).cast("long")), F.array(*[F.col(d) for d in dims])
    for level in range(math.ceil(math.log2(leaves)) if total["n"] else 0):
        n = 1 << level  # the most nodes that are open
        open_ = meta.where("parts > 1")
        cuts = written(_split(open_, list(dims), whole, n), "kd-cuts")
        joined = meta.join(maybe_broadcast(cuts.withColumnRenamed("node", "_node"), n, BROADCAST_ROWS), F.col("node") == F.col("_node"), "left")
        v, half = place[F.col("dim")], F.expr("parts div 2")
        left = (v < F.col("cut")) | ((v == F.col("cut")) & (F.col("tie") <= F.col("tie_cut")))
        of = lambda stay, go_left, go_right: F.when(F.col("cut").isNull(), stay).when(left, go_left).otherwise(go_right)  # noqa: B023, E731
        node, parts = of(F.col("node"), F.col("node"), F.col("node") + half), of(F.col("parts"), half, F.col("parts") - half)
        meta = written(joined.select(*[c for c in meta.columns if c not in ("node", "parts")], node.alias("node"), parts.alias("parts")), "kd-level")
    return _slots(meta.withColumnRenamed("node", "shard"), total["n"])


def _slots(rows: DataFrame, n: int) -> DataFrame:
    """Number the rows of each shard from 0: by ordered groups, whose starts are prefix sums of counts."""
    groups = max(1, math.ceil(n / SLOT_ROWS))
    rows = rows.withColumn("_group", F.pmod(F.col("tie"), F.lit(groups)))
    counts = rows.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("tie", "doc_id", "text_crc32")) - 1
    numbered = rows.withColumn("_at", inside).join(starts, ["shard", "_group"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.coalesce("_start", F.lit(0)) + F.col("_at")).cast("long").alias("slot"))
