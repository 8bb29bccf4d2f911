"""Set similarity join by count vectors in packed R-trees.

A document's set of word shingles is hashed into groups; the numbers of
shingles by group are a point.  Two sets share at most the sum, over the
groups, of the lesser count, which bounds their similarity from above; the
same sum over the upper corners of two boxes bounds all pairs of points in them.

Points meet where a pair has to meet: shingles are ordered by how full their
(fine) group is in the whole corpus, rarest first.  Two sets that are similar
enough share a shingle among the first n - ceil(t n) + 1 of each, so a point
is entered under each of these.  The points under one shingle, sorted by size,
are packed into boxes; pairs of boxes, then of points, that pass the bound are
candidates, and candidates are verified on their whole sets.

Equal sets are one point, known by a hash of the set.  ``similar_pairs`` gives
all links between points.  For ``similar_groups`` only connectedness counts:
a first round verifies one candidate for each entry and joins what it links.
Each later round verifies the best candidates between components that are
still apart, a few for each pair of components under a shingle, and more of
them each time until no candidate is left that was not looked at.  So what
leaves a task grows with components and not with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, done_with, maybe_broadcast, released, small_batches, text_key, without, written
from tidemill.llm.components import components
from tidemill.llm.hashing import shingles, utf8, words_by_row

#: Groups of the count vectors, and fine groups by whose totals shingles are ordered.
DIMENSIONS, FINE_BITS = 256, 20
#: Counts from here on are only known to be as large.
FULL = 255
#: Points of a box; points under one shingle that are joined in one piece; pairs whose bounds are taken at once.
LEAF, TILE, PAIRS = 32, 2048, 25_000
#: Rows with a text, with two sets or with a vector that a worker is sent at once.
TEXTS, SETS, VECTORS = 1000, 250, 4000
#: Candidates of a pair of components in the second round, and how many times more in each round after it.
FEW, MORE = 16, 16


def needed(a, b, percent: int):
    """The least overlap of sets of a and b elements with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for words in words_by_row(*utf8(batch.column(1))):
        yield shingles(words, k)


def _totals(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """How many (document, shingle) pairs each fine group has, in slices."""
    totals = np.zeros(1 << FINE_BITS, np.int64)
    for batch in batches:
        found = list(_sets(batch, k))
        if found:
            totals += np.bincount((np.concatenate(found) >> np.uint64(64 - FINE_BITS)).astype(np.int64), minlength=len(totals))
    slices = np.minimum(totals, 2**31 - 1).astype(np.int32).reshape(64, -1)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(range(64), pa.int32()), "counts": pa.array([s.tobytes() for s in slices], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[s] = sums.get(s, 0) + np.frombuffer(c, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def group_totals(docs: DataFrame, k: int) -> np.ndarray:
    """Totals of the fine groups over all documents: 2**FINE_BITS numbers, whatever the input's size."""
    parts = docs.mapInArrow(released(lambda it: _totals(it, k)), "slice int, counts binary").repartition("slice").mapInArrow(_added, "slice int, counts binary").collect()
    out = np.zeros((64, (1 << FINE_BITS) // 64), np.int64)
    for r in parts:
        out[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def _digests(sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit hash of each set, which tells points apart."""
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())


def points(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, fp, n, p (a hash of the set), vector, prefix of docs with doc_id, text and fp."""
    totals = docs.sparkSession.sparkContext.broadcast(group_totals(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = totals.value
        for batch in batches:
            vectors, prefixes, sets = [], [], list(_sets(batch, k))
            for s in sets:
                vectors.append(np.minimum(np.bincount((s & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS), FULL).astype(np.uint8).tobytes())
                size = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                rarest = np.lexsort((s, full[(s >> np.uint64(64 - FINE_BITS)).astype(np.int64)]))[:size]
                prefixes.append(s[rarest].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), pa.array(vectors, pa.binary()), prefix], ["doc_id", "fp", "n", "p", "vector", "prefix"])

    return docs.mapInArrow(released(run), "doc_id long, fp long, n long, p binary, vector binary, prefix array<long>")


def shared_bound(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that pairs of points can share: summed minima of their counts; without bound if both have a full count in a group."""
    low = np.minimum(vectors[a], vectors[b])
    out = low.sum(axis=1, dtype=np.int32)
    out[(low == FULL).any(axis=1)] = 2**30
    return out


def box_pairs(n: np.ndarray, vectors: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points (later, earlier) in boxes whose bound lets a pair in; a box is a leaf of points sorted by size."""
    begins = np.arange(0, len(n), LEAF)
    upper = np.maximum.reduceat(vectors, begins, axis=0)
    least = np.minimum.reduceat(n, begins)
    for i in range(len(begins)):
        bound = shared_bound(upper, np.full(i + 1, i), np.arange(i + 1))
        mine = np.arange(begins[i], min(begins[i] + LEAF, len(n)), dtype=np.int32)
        for j in np.flatnonzero(bound >= needed(least[i], least[: i + 1], percent)):
            theirs = np.arange(begins[j], min(begins[j] + LEAF, len(n)), dtype=np.int32)
            a, b = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
            yield (a[a > b], b[a > b]) if i == j else (a, b)


def run_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (later, earlier) inside consecutive runs of these sizes."""
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)  # each point meets all before it in its run
    a = np.repeat(np.arange(len(place)), place)
    ahead = np.cumsum(place) - place
    return a, a - 1 - (np.arange(len(a)) - np.repeat(ahead, place))


def passing(n: np.ndarray, vectors: np.ndarray, labels: np.ndarray, side: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of places those with different labels whose bound is large enough, and their bounds."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for a, b in pairs:
        a, b = a.astype(np.int32, copy=False), b.astype(np.int32, copy=False)
        ok = (labels[a] != labels[b]) & ((side[a] != side[b]) | (side[a] == 2)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            bound = shared_bound(vectors, x, y)
            ok = bound >= needed(n[x], n[y], percent)
            found.append((x[ok], y[ok], bound[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def chosen(point: np.ndarray, label: np.ndarray, n: np.ndarray, found: tuple[np.ndarray, ...], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which candidates leave: (a, b, more), a and b places.

    most 0: the partner nearest in size for each point.  Else up to `most`
    of each pair of labels, best bounds first; more tells that there were
    others.  None: all of them.  point, label: numbers for points and labels.
    """
    a, b, bound = found
    if not len(a):
        return a, b, np.zeros(0, bool)
    low, high = np.minimum(point[a], point[b]), np.maximum(point[a], point[b])
    _, once = np.unique(low * (len(point) + 1) + high, return_index=True)  # a pair that meets under several shingles here
    a, b, bound = a[once], b[once], bound[once]
    if most is None:
        return a, b, np.zeros(len(a), bool)
    if most == 0:
        group, order = point[a], np.lexsort((point[b], np.abs(n[a] - n[b]), point[a]))
    else:
        group = np.minimum(label[a], label[b]) * (len(label) + 1) + np.maximum(label[a], label[b])
        order = np.lexsort((high[once], low[once], -bound / (n[a] + n[b]), group))
    group = group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.flatnonzero(first)
    rank = np.arange(len(group)) - begin[np.cumsum(first) - 1]
    size = np.diff(np.concatenate([begin, [len(group)]]))[np.cumsum(first) - 1]
    keep = rank < max(1, most)
    return a[order][keep], b[order][keep], (size > max(1, most))[keep]


def _join(batches: Iterator[pa.RecordBatch], percent: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, side, p, n, vector, label) come sorted by token, key and n; candidate pairs of points leave.

    Under one token and key are the points of one shingle, or of a tile of
    them against another.  Short runs are taken together, long ones by boxes.
    """

    def pairs(rows: list[tuple[np.ndarray, ...]], sizes: np.ndarray) -> pa.RecordBatch:
        side, n, p, label, vectors = (np.concatenate(x) for x in zip(*rows))
        if len(sizes) == 1 and sizes[0] > LEAF:
            order = np.argsort(n, kind="stable")
            side, n, p, label, vectors = side[order], n[order], p[order], label[order], vectors[order]
            inside = box_pairs(n, vectors, percent)
        else:
            inside = iter([run_pairs(sizes)])
        names, point = np.unique(p, return_inverse=True)
        _, label = np.unique(label, return_inverse=True)
        a, b, more = chosen(point, label, n, passing(n, vectors, label, side, inside, percent), most)
        x, y = np.minimum(point[a], point[b]), np.maximum(point[a], point[b])
        of = lambda i: pa.Array.from_buffers(pa.binary(16), len(i), [None, pa.py_buffer(names[i].tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([of(x), of(y), pa.array(more)], ["a", "b", "more"])

    held, current = [], None  # the run that may go on in the next batch
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
        if not len(key):
            continue
        fixed = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "S16")  # noqa: B023, E731
        columns = [batch.column(2).to_numpy(), batch.column(4).to_numpy(), fixed(3), fixed(6)]
        vectors = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        part = lambda lo, hi: (*(c[lo:hi] for c in columns), vectors[lo:hi])  # noqa: B023, E731
        first = 0
        if held:
            if current == tuple(key[0]):
                held.append(part(0, cuts[1]))
                first = 1
            if len(cuts) > 2 or not first:
                yield pairs(held, np.array([sum(len(h[0]) for h in held)]))
                held = []
        if first < len(cuts) - 1:
            sizes = np.diff(cuts[first:])
            short = []
            for i in range(len(sizes) - 1):
                lo, hi = cuts[first + i], cuts[first + i + 1]
                if sizes[i] > LEAF:
                    yield pairs([part(lo, hi)], np.array([hi - lo]))
                elif sizes[i] > 1:
                    short.append(np.arange(lo, hi))
            if short:
                at = np.concatenate(short)
                yield pairs([(*(c[at] for c in columns), vectors[at])], np.array([len(x) for x in short]))
            held, current = [part(cuts[-2], cuts[-1])], tuple(key[-1])
    if held:
        yield pairs(held, np.array([sum(len(h[0]) for h in held)]))


def _tile(name: str, tiles: Column) -> Column:
    """A tile of a shingle's points; other shingles deal the same points differently, so that links cross tiles."""
    return F.pmod(F.xxhash64(F.lit(name), "token", "p"), tiles)


def _met(once: DataFrame, percent: int) -> DataFrame:
    """Entries (token, p, n, total) of points under the shingles of their prefixes, where a point near in size is entered too.

    Nothing is sorted or numbered by shingle: bands of sizes are counted, and
    sizes that are similar enough lie in one band or in two that touch.
    """
    step = max(math.log(100 / percent) * (1 + 1e-9), 1e-9)
    entered = once.select("p", "n", F.explode("prefix").alias("token"), F.pmod(F.floor(F.log("n") / step), F.lit(64)).cast("int").alias("band"))
    bands = entered.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"))
    bit = "shiftleft(1L, band)"
    known = bands.groupBy("token").agg(F.sum("c").alias("total"), F.expr(f"bit_or({bit})").alias("held"), F.expr(f"bit_or(if(c > 1, {bit}, 0L))").alias("twice")).where("total > 1")
    beside = "((shiftrightunsigned(held, pmod(band + 1, 64)) | shiftrightunsigned(held, pmod(band + 63, 64)) | shiftrightunsigned(twice, band)) & 1L) = 1L"
    return entered.join(known.hint("merge"), "token").where(beside).select("token", "p", "n", "total")


def _tiled(met: DataFrame) -> DataFrame:
    """Entries of the first round: a shingle with many points is cut into tiles, which are joined each by itself."""
    return met.select("token", _tile("own", F.ceil(F.col("total") / TILE)).alias("key"), F.lit(2).alias("side"), "p", "n", F.col("p").alias("label"))


def _opposed(labelled: DataFrame) -> DataFrame:
    """Entries (token, p, n, total, label) as (token, key, side, p, n, label), so that all with different labels under a shingle meet.

    Shingles whose points all have one label are done.  Where there are many
    points, only those outside the largest component are tiled against all.
    """
    apart = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_ = labelled.join(apart, "token")
    small = open_.where(F.col("total") <= TILE).select("token", F.lit(0).cast("long").alias("key"), F.lit(2).alias("side"), "p", "n", "label")
    large = open_.where(F.col("total") > TILE)
    counts = large.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.ceil((F.sum("c") - F.max("c")) / TILE).alias("others"), F.ceil(F.sum("c") / TILE).alias("all"))
    large = large.join(main, "token")
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    ours = large.where(F.col("label") != F.col("main")).withColumn("i", _tile("others", F.col("others"))).withColumn("j", F.explode(to(F.col("all")))).withColumn("side", F.lit(0))
    theirs = large.withColumn("j", _tile("all", F.col("all"))).withColumn("i", F.explode(to(F.col("others")))).withColumn("side", F.lit(1))
    both = ours.unionByName(theirs).select("token", (F.col("i") * F.col("all") + F.col("j")).alias("key"), "side", "p", "n", "label")
    return small.unionByName(both)


def _candidates(entries: DataFrame, vectors: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b, more) from entries (token, key, side, p, n, label)."""
    full = entries.join(vectors.hint("merge"), "p").select("token", "key", "side", "p", F.col("n").cast("long").alias("n"), "vector", "label")
    met = full.repartition("token", "key").sortWithinPartitions("token", "key", "n").mapInArrow(released(lambda it: _join(it, percent, most)), "a binary, b binary, more boolean")
    return met.groupBy("a", "b").agg(F.max("more").alias("more"))


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of points whose whole sets are similar enough; holders: p, and doc_id and fp of a row with that set."""
    ids = pairs.select(F.col("a").alias("p")).union(pairs.select("b")).distinct()
    rows = written(ids.join(holders, "p").select(F.col("p").alias("_p"), F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")), "holders")
    texts = docs.join(maybe_broadcast(rows, rows.count(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp"))).select("doc_id", "text", "_p")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([s.tobytes() for s in _sets(batch, k)], pa.binary())], ["p", "set"])

    with small_batches(docs.sparkSession, TEXTS):
        held = written(texts.mapInArrow(released(sets), "p binary, set binary").dropDuplicates(["p"]), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = held.select(F.col("p").alias("a"), F.col("set").alias("x"))
    two = held.select(F.col("p").alias("b"), F.col("set").alias("y"))
    with small_batches(docs.sparkSession, SETS):
        links = written(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(released(check), "a binary, b binary"), "links")
    done_with(held, rows)
    return links


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("fp"))


def _prepared(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points of all rows; of each class of equal sets its holder, its vector, and its entries."""
    with small_batches(docs.sparkSession, TEXTS):
        every = written(points(docs, k, percent), "points")
    # Rows with equal sets collapse before the shuffle, so a set that fills the corpus moves once per partition.
    filled = every.where("n > 0")
    classes = written(filled.groupBy("p").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "fp")).alias("row")).select("p", "least", "row.doc_id", "row.fp"), "classes")
    once = written(filled.groupBy("p").agg(F.first("n").alias("n"), F.first("vector").alias("vector"), F.first("prefix").alias("prefix")), "once")
    return every, classes, once.select("p", "vector"), written(_met(once, percent), "met")


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of all rows, classes of equal sets, and the component (id, component) of every class with a link."""
    every, classes, vectors, met = _prepared(docs, k, percent)
    with small_batches(docs.sparkSession, VECTORS):
        done = written(_candidates(_tiled(met), vectors, percent, 0).select("a", "b"), "pairs")
    links, most, open_ = _verified(done, docs, classes, k, percent), FEW, None
    # Two rounds bring nearly all of a group together, which is what later rounds need to leave out.
    labels, whole = written(components(links, 2), "labels"), False
    while True:
        labelled = met.join(labels.withColumnRenamed("id", "p").hint("merge"), "p", "left").select("token", "p", "n", "total", F.coalesce("component", "p").alias("label"))
        if open_ is not None:
            labelled = labelled.join(open_, "label", "left_semi")
        found = _candidates(_opposed(labelled), vectors, percent, most)
        with small_batches(docs.sparkSession, VECTORS):
            found = written(found.join(done.withColumn("old", F.lit(True)), ["a", "b"], "left"), "pairs")
        new = found.where("old is null").select("a", "b")
        linked = _verified(new, docs, classes, k, percent)
        if not linked.isEmpty():
            links = written(links.union(linked), "links")
            labels, whole = written(components(links), "labels"), True
        # Components between which candidates were left over, as far as they are still apart.
        of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))  # noqa: B023, E731
        left = found.where("more").select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
        open_ = written(left.select(F.col("x").alias("label")).union(left.select("y")).distinct(), "open")
        if open_.isEmpty():
            return every, classes, labels if whole else written(components(links), "labels")
        done, most = written(done.union(new), "pairs"), most * MORE


def similar_pairs(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) of similar classes of equal sets, and the members (doc_id, fp, p, n) of every class.

    Null and wordless texts have n 0 and no links.  The links of g texts that
    are all alike are g * (g - 1) / 2 rows; similar_groups does without them.
    """
    docs = _rows(docs)
    every, classes, vectors, met = _prepared(docs, k, percent)
    with small_batches(docs.sparkSession, VECTORS):
        pairs = written(_candidates(_opposed(met.withColumn("label", F.col("p"))), vectors, percent, None), "pairs")
    return _verified(pairs, docs, classes, k, percent), every.select("doc_id", "fp", "p", "n")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, fp, n, p, c (the component's point, null without words), component_id of every row."""
    every, classes, labels = _components(_rows(docs), k, percent)
    known = classes.join(labels.withColumnRenamed("id", "p"), "p", "left").select("p", "least", F.coalesce("component", "p").alias("c"))
    known = written(known, "components")
    least = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = known.join(least, "c").select(F.col("p").alias("_p"), "c", "component_id")
    return every.select("doc_id", "fp", "n", "p").join(known, (F.col("p") == F.col("_p")) & (F.col("n") > 0), "left").drop("_p")


def similar_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of non-space bytes, A-Z lowered; a set has the distinct
    k-word shingles, or the whole sequence if there are fewer words.  Sets
    link when 100 * overlap >= percent * union; component_id is the least
    doc_id that links lead to (rows without one link as others do, but give no
    id).  Null and wordless texts have empty sets and link with nothing.  Rows
    with equal sets are linked with each other.  Rows that repeat a doc_id are
    one document each, with a set of its own.  Long texts count whole.  An
    empty table gives an empty result; columns besides doc_id and text are not
    read, whatever their names.
    """
    out = _grouped(docs, k, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs with one row of each group, that of the least doc_id; all columns stay.

    Rows without a doc_id come last in their group.  Of rows of the group that
    share the least doc_id the one with the least hash of its text stays, and
    of rows equal in both any one.  Rows without words all stay.
    """
    rows = written(_grouped(docs, k, percent).where("n > 0").select("doc_id", "fp", "c"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    best = rows.groupBy("c").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("c", "_c")
    of = rows.join(best, F.col("c") == F.col("_c"))
    gone = of.where(place != F.col("best"))
    repeated = rows.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return without(docs, gone, repeated)
