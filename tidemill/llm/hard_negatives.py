"""Hard negatives by blocked matrix products.

Anchors are dealt into blocks of bounded size.  A block is broadcast, and every
task multiplies it with its own rows, a slice at a time, and keeps the best
rows of each anchor; the best of all tasks follow by merging.  A first pass
finds the positives, whose scores give windows; a second one the best rows of
other labels in each window.  Products are taken in double precision where no
sum can reach 2**53 and are exact there; else in 64-bit or longer integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import written

#: Bytes of an anchor block as doubles; it bounds what is broadcast and collected.
BLOCK_BYTES = 4 << 20
#: Scores held at a time.
SCORES = 2_000_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, whole-numbered vectors as doubles


def candidates(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part."""
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.col("embedding").cast("array<double>")
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), changed.alias("label"), vector.alias("vector"))
    # Without a null component: exists() is null, not true, where only nulls stand against it.
    strange = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~strange)


def _slices(batch: pa.RecordBatch, block: Block) -> Iterator[Block]:
    """The batch's rows that have as many components as the block, so many at a time that their scores fit."""
    ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    width = block[2].shape[1]
    sizes = np.diff(vectors.offsets.to_numpy())
    same = np.flatnonzero(sizes == width)
    flat, begin = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    step = max(1, SCORES // len(block[0]))
    for at in range(0, len(same), step):
        rows = same[at : at + step]
        yield ids[rows], labels[rows], np.floor(256 * flat[begin[rows][:, None] + np.arange(width)])


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers given as doubles; beyond 64 bits the largest or least such number."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = np.abs(anchors).sum(axis=1).max() * np.abs(rows).max(axis=1)
    out = np.empty((len(anchors), len(rows)), np.int64)
    exact, whole = most < 2.0**53, most < 2.0**62
    out[:, exact] = anchors @ rows[exact].T
    if (rest := np.flatnonzero(~exact & whole)).size and np.abs(anchors).max() < 2.0**62:
        out[:, rest] = anchors.astype(np.int64) @ rows[rest].astype(np.int64).T
        exact[rest] = True
    if (rest := np.flatnonzero(~exact)).size:
        long = lambda x: np.array([[int(v) for v in r] for r in x], object)
        out[:, rest] = np.clip(long(anchors) @ long(rows[rest]).T, int(_LEAST) + 1, int(_MOST)).astype(np.int64)
    return out


class Best:
    """The best few (score, id) of each of so many lists, over slices of rows; equal pairs count once."""

    def __init__(self, lists: int, few: int):
        self.few = few
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(lists, _LEAST + 1)  # what enters has to reach it

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores, allowed: a row for each list, a column for each id."""
        held = np.where(allowed, scores, _LEAST)
        least = self.least
        # Equal pairs count once, so the slice's own bound holds only if each id comes once.
        if held.shape[1] > self.few and (least == _LEAST + 1).any() and len(np.unique(ids)) == len(ids):
            least = np.maximum(least, np.partition(held, held.shape[1] - self.few, axis=1)[:, -self.few])
        at, row = np.nonzero(held >= least[:, None])
        if not len(at):
            return
        self.list, self.score, self.id = np.concatenate([self.list, at]), np.concatenate([self.score, held[at, row]]), np.concatenate([self.id, ids[row]])
        order = np.lexsort((self.id, -self.score, self.list))
        kept = tuple(x[order] for x in (self.list, self.score, self.id))
        new = np.ones(len(order), bool)
        new[1:] = reduce(np.logical_or, (x[1:] != x[:-1] for x in kept))
        kept = tuple(x[new] for x in kept)
        first = np.concatenate([[True], kept[0][1:] != kept[0][:-1]])
        rank = np.arange(len(first)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        self.list, self.score, self.id = (x[rank < self.few] for x in kept)
        full = np.flatnonzero(rank == self.few - 1)
        self.least[kept[0][full]] = kept[1][full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.list), pa.array(self.score), pa.array(self.id)], ["list", "score", "id"])


def merged(found: DataFrame, few: int) -> DataFrame:
    """list, score, id, rank: the best of what the tasks found for each list."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= few).distinct()


def positives(rows: DataFrame, block: Block, few: int) -> DataFrame:
    """list (place in the block), score, id, rank of each anchor's best other rows of its label."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, vectors = held.value
        best = Best(len(anchors), few)
        for batch in batches:
            for ids, theirs, values in _slices(batch, held.value):
                best.add(scores(vectors, values), (labels[:, None] == theirs) & (anchors[:, None] != ids), ids)
        yield best.batch()

    return merged(rows.mapInArrow(run, "list long, score long, id long"), few)


def negatives(rows: DataFrame, block: Block, near: tuple[np.ndarray, np.ndarray], few: int, low: int, high: int) -> DataFrame:
    """list (place in near), score, id, rank: each positive's best rows of other labels in its window.

    near: of each positive the place of its anchor in the block, and its score.
    """
    held = rows.sparkSession.sparkContext.broadcast((block, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (place, score) = held.value
        # Windows of whole numbers: low * score <= 100 * x <= high * score.
        bounds = [(-(-low * int(s) // 100), high * int(s) // 100) for s in score]
        least, most = (np.array([min(max(b[i], int(_LEAST) + 1), int(_MOST)) for b in bounds], np.int64) for i in (0, 1))
        # The positives of an anchor one by one, so that a matrix of scores serves them all.
        turn = np.zeros(len(place), np.int64)
        order = np.argsort(place, kind="stable")
        first = np.concatenate([[True], place[order][1:] != place[order][:-1]])
        turn[order] = np.arange(len(place)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        turns = [np.flatnonzero(turn == t) for t in range(turn.max() + 1)]
        best = [Best(len(t), few) for t in turns]
        for batch in batches:
            for ids, theirs, values in _slices(batch, block):
                found = scores(block[2], values)
                other = (block[1][:, None] != theirs) & (block[0][:, None] != ids)
                for t, b in zip(turns, best):
                    x, a = found[place[t]], place[t]
                    b.add(x, other[a] & (x >= least[t][:, None]) & (x <= most[t][:, None]), ids)
        for t, b in zip(turns, best):
            b.list = t[b.list]
            yield b.batch()

    return merged(rows.mapInArrow(run, "list long, score long, id long"), few)


def _blocks(anchors: DataFrame) -> DataFrame:
    """The anchors with a block: rows of one width that fit in BLOCK_BYTES twice at most."""
    sizes = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, sizes["width"] or 1)))
    dealt = written(anchors.repartition(max(1, -(-sizes["n"] // most))), "anchors")
    # Places within a partition, in runs of twice the usual number.
    run = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / (2 * most))
    return written(dealt.select("vec_id", "label", "vector", F.concat_ws(":", F.size("vector"), F.spark_partition_id(), run).alias("block")), "anchors")


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label.  Rows with a null id, label or vector, or
    a null or non-finite component, take no part; where vec_id is divisible by
    7, label is (label + 1) % 10.  A score is the inner product of the whole
    numbers floor(256 x).  is_anchor tells anchors (vec_id divisible by 50).
    An anchor's positives are its n_positives best other rows of its label;
    for each, the n_negatives best rows of other labels whose score is from
    low to high percent of the positive's are returned.  Equal scores: the
    lesser id first.

    Rows with the anchor's own vec_id are never its partners.  Rows that share
    id and score count once; anchors equal in all their columns are one, and
    anchors that share an id but differ have lists of their own under that
    id.  Vectors only meet those of the same length; empty ones have score 0.
    Scores beyond 64 bits are the largest or least such number.  An empty
    table gives an empty result.  Other columns are not read.
    """
    spark = rows.sparkSession
    known = candidates(rows)
    anchors = _blocks(known.where(F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor).distinct())
    out = []
    for name in sorted(r["block"] for r in anchors.select("block").distinct().toLocalIterator()):
        own = anchors.where(F.col("block") == name).select("vec_id", "label", "vector").orderBy("vec_id", "label").toArrow()
        vectors = own.column(2).combine_chunks()
        values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(vectors.flatten()) else np.zeros((len(own), 0))
        block = (own.column(0).to_numpy(), own.column(1).to_numpy(), np.floor(256 * values))
        # As many rows as the block has anchors, times n_positives.
        near = positives(known, block, n_positives).select("list", "score", "id").orderBy("list", "score", "id").toArrow()
        if not near.num_rows:
            continue
        place, score, partner = (near.column(c).to_numpy() for c in ("list", "score", "id"))
        found = negatives(known, block, (place, score), n_negatives, low, high)
        names = pa.table({"_list": pa.array(np.arange(len(place))), "anchor_id": pa.array(block[0][place]), "positive_id": pa.array(partner), "positive_score": pa.array(score)})
        # A table as large as the block's positives: broadcast without a count.
        named = found.join(F.broadcast(spark.createDataFrame(names)), F.col("list") == F.col("_list"))
        out.append(written(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))])
    return reduce(DataFrame.unionByName, out)
