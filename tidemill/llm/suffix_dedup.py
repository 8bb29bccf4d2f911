"""Removal of long repeated substrings by suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts
anywhere else in the corpus, the same text included.

1. Equal texts are one text.  If it is long enough, its copies go whole.
2. Every start of a string is filed under the least hash of the k-grams
   inside the string, which is the same for equal strings wherever they are.
   Consecutive starts with the same key are one context.  Keys whose k-gram
   is found in one place only cannot hold a repeated string and are done.
3. Equal contexts of a key become one with a count; those that count two
   repeat as they are.  The contexts left under a key are gathered in shards; a
   shard gets its suffix array by Larsson-Sadakane refinement and its common
   prefixes by Kasai's inequality.  A key with more contexts than a shard holds is cut
   into several, whose suffix arrays are merged by binary search.
4. A key with more than HOT bytes of contexts (such as a common line in ever
   other surroundings) would not fit one task.  Its contexts are filed once more,
   each start under the least k-gram by another hash, which equal strings share
   too and which mostly lies in the surroundings; keys of one place are done
   again, and the rest goes through steps 2 to 4.  Where that no longer makes
   the contexts fewer, strings are counted by their own hashes.
5. What repeats is joined back to every text with that context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, written
from tidemill.llm.hashing import mix, prefix_sums, substring_hashes, utf8

GRAM = 16
#: Starts looked at in one go; starts of one context; bytes of a shard, and of the contexts of a key that one task takes.
STEP, CONTEXT, SHARD, HOT = 1 << 19, 4096, 1 << 18, 1 << 20
#: How often contexts of hot keys are filed anew, and what share of them may be left each time to go on.
LEVELS, LEFT = 12, 0.9
#: Contexts that a task counts before it sends the counts on.
COUNTED = 1_000_000


# ---- suffix arrays ----


def _keys(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in byte order; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]).view(">u8").astype(np.uint64).ravel()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of a text in the order of what starts there.

    Places are sorted by eight bytes; groups that are still tied are refined
    by the rank of the place h further on, and h doubles.
    """
    n, keys = len(text), _keys(text)
    # Suffixes of less than eight bytes come before longer ones with the same (zero-filled) key, shortest first.
    tail = np.arange(n - 1, max(-1, n - 8), -1)
    places = np.concatenate([tail, np.arange(n - len(tail))])
    order = places[np.argsort(keys[places], kind="stable")]
    rank = np.empty(n, np.int64)
    at, sorted_keys, h = np.arange(n), keys[order], 8
    short = order > n - 8
    while True:
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        if h == 8:
            new[1:] |= short[1:] | short[:-1]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = first
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = at[tied]
        if not len(at):
            return order
        place = order[at]
        further = np.where(place + h < n, rank[np.minimum(place + h, n - 1)] + 1, 0)
        key = rank[place] * (n + 1) + further
        by = np.argsort(key)
        order[at], sorted_keys = place[by], key[by]
        h *= 2


def _extend(keys: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, of which `known` bytes are known to agree; no more than `most` is looked at."""
    out, n = known.copy(), len(keys)
    active = np.flatnonzero((out < most) & (np.maximum(a, b) + out < n))
    while len(active):
        x = keys[a[active] + out[active]] ^ keys[b[active] + out[active]]
        same = np.full(len(x), 8)
        differ = x != 0
        same[differ] = sum((x[differ] < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, 8))
        same = np.minimum(same, n - np.maximum(a[active], b[active]) - out[active])
        out[active] += same
        active = active[(same == 8) & (out[active] < most) & (np.maximum(a[active], b[active]) + out[active] < n)]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, every: int = 32) -> np.ndarray:
    """For each place the common prefix (up to `most`) with the place before it in the suffix array.

    By Kasai's inequality the value falls by at most one from a place to the
    next, so a few places are compared from scratch and the rest from what they leave over.
    """
    n, keys = len(text), _keys(text)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    out = np.zeros(n, np.int64)
    for places, known in ((np.arange(0, n, every), None), (np.arange(n), True)):
        if known is not None:
            known = np.maximum(0, out[places // every * every] - places % every)
        else:
            known = np.zeros(len(places), np.int64)
        ok = before[places] >= 0
        out[places[ok]] = _extend(keys, places[ok], before[places[ok]], known[ok], most)
    return out


def repeats_in_shard(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in suffix order, and for each whether its string equals that of a neighbour."""
    order = suffix_array(text)
    prefixes = common_prefixes(text, order, length)[order]
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    at = np.flatnonzero(is_start[order])
    # Between two starts the common prefix is the least of those on the way.
    low = np.minimum.reduceat(prefixes[: at[-1] + 1], np.concatenate([at[:1], at[:-1] + 1])) if len(at) else np.zeros(0, np.int64)
    same = low >= length
    same[:1] = False
    hit = same.copy()
    hit[:-1] |= same[1:]
    return order[at], hit


def _less(keys: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string at a is less than that at b, and whether they are equal."""
    shared = _extend(keys, a, b, np.zeros(len(a), np.int64), length)
    equal = shared >= length
    shift = np.minimum(shared, length - 1)
    return ~equal & (keys[a + shift] >> np.uint64(56) < keys[b + shift] >> np.uint64(56)), equal


def merge_by_search(keys: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge two sorted lists of starts; also which of each has its string in the other."""
    low, high = np.zeros(len(right), np.int64), np.full(len(right), len(left))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        less, _ = _less(keys, left[mid], right[open_], length)
        low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
    found = np.zeros(len(right), bool)
    inside = np.flatnonzero(low < len(left))
    found[inside] = _less(keys, left[low[inside]], right[inside], length)[1]
    other = np.zeros(len(left) + 1, np.int64)
    for i in low[found]:  # equal strings stand together from the place found on
        other[i] = 1
    hit_left = other[:-1].astype(bool)
    if len(left) > 1:
        same = np.concatenate([[False], _less(keys, left[:-1], left[1:], length)[1]])
        group = np.cumsum(~same)
        hit_left = np.isin(group, group[hit_left])
    return np.insert(left, low, right), hit_left, found


def repeated_starts(contexts: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each context (at least length bytes) which of its starts have their string anywhere else among the contexts."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hit = np.zeros(len(text), bool)
    cuts = [0]
    for i in range(1, len(contexts)):
        if begin[i] + sizes[i] - begin[cuts[-1]] > shard:
            cuts.append(i)
    lists = []
    for lo, hi in zip(cuts, [*cuts[1:], len(contexts)]):
        a, b = int(begin[lo]), int(begin[hi - 1] + sizes[hi - 1])
        own = starts[(starts >= a) & (starts < b)]
        order, found = repeats_in_shard(text[a:b], own - a, length)
        hit[order[found] + a] = True
        lists.append(order + a)
    if len(lists) > 1:
        keys = _keys(text)
        while len(lists) > 1:
            merged = []
            for left, right in zip(lists[::2], lists[1::2]):
                both, x, y = merge_by_search(keys, left, right, length)
                hit[left[x]] = hit[right[y]] = True
                merged.append(both)
            lists = merged + lists[len(lists) // 2 * 2 :]
    return [hit[b : b + c] for b, c in zip(begin, counts)]


# ---- contexts ----


def _sliding(f: np.ufunc, x: np.ndarray, w: int, fill) -> np.ndarray:
    """f over every w neighbours, from running values inside blocks of w."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = f.accumulate(padded, axis=1).ravel()
    back = f.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int, level: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, number of starts, key, places of the key's k-gram, 1 or 2 for more) of every context, some rows at a time."""
    lo, hi, w = int(offsets[0]), int(offsets[-1]), length - GRAM + 1
    most = np.uint64(2**64 - 1)
    for a in range(lo, hi, STEP):
        part = data[a : min(hi, a + STEP + length - 1)]
        if len(part) < length:
            break
        sums = prefix_sums(part)
        at = np.arange(len(part) - GRAM + 1)
        grams = substring_hashes(sums, at, at + GRAM)
        if level:  # another order of the same grams
            grams = mix(grams + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        least = _sliding(np.minimum, grams, w, most)
        n = len(least)
        # Starts whose string would reach into the next row are none.
        edge = offsets[(offsets > a) & (offsets < a + len(part) + 1)] - a
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, np.clip(edge - length + 1, 0, n), 1)
        np.add.at(cover, np.clip(edge, 0, n), -1)
        valid = np.cumsum(cover[:-1]) == 0
        cut = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
        begin = np.flatnonzero(cut)
        size = np.diff(np.concatenate([begin, [n]]))
        begin, size = begin[valid[begin]], size[valid[begin]]
        if (size > CONTEXT).any():
            pieces = -(-size // CONTEXT)
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            end = np.repeat(begin + size, pieces)
            begin = np.repeat(begin, pieces) + number * CONTEXT
            size = np.minimum(end - begin, CONTEXT)
        key = least[begin]
        # A gram is a key where it is the least of some string around it.
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        chosen = grams[_sliding(np.maximum, padded, w, np.uint64(0)) == grams]
        value, count = np.unique(chosen, return_counts=True)
        more = value[count > 1]
        row = np.searchsorted(offsets, begin + a, "right") - 1
        yield row, begin + a - offsets[row], size, key, 1 + np.isin(key, more)


def _file(batches: Iterator[pa.RecordBatch], length: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp, text, parent); the contexts of the texts, under keys within those of the parent."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, fps, parents = (batch.column(c).to_numpy() for c in (0, 1, 3))
        for row, start, size, key, places in contexts_of(data, offsets, length, level):
            if level:
                key = mix(key + parents[row].view(np.uint64) * np.uint64(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(fps[row]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(places.astype(np.int32))], ["k", "fp", "start", "size", "key", "places"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts with a hash of their bytes.

    The first of equal contexts of a partition takes along the bytes and
    counts as often as its text; a last row without a text counts the others.
    """
    seen: dict[tuple[int, bytes], int] = {}  # those after the first

    def counts() -> Iterator[pa.RecordBatch]:
        more = [(None, None, None, None, key, digest, n, None) for (key, digest), n in seen.items() if n]
        for i in range(0, len(more), 20_000):
            yield rows(more[i : i + 20_000])
        seen.clear()

    rows = lambda out: pa.RecordBatch.from_pylist([dict(zip(_CUT.names, r)) for r in out], _CUT)
    for batch in batches:
        out: list[tuple] = []
        for k, fp, text, places, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist()):
            data = memoryview(text.as_buffer())
            fields = places.values
            for start, size, key in zip(*(fields.field(i).to_pylist() for i in range(3))):
                held = data[start : start + size + length - 1]
                digest = xxhash.xxh3_128_digest(held)
                before = seen.get((key, digest))
                seen[key, digest] = 0 if before is None else before + times
                out.append((k, fp, start, size, key, digest, times if before is None else 0, bytes(held) if before is None else None))
            if len(out) > 20_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)
        if len(seen) > COUNTED:
            yield from counts()
    yield from counts()


_CUT = pa.schema([("k", pa.int64()), ("fp", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bytes", pa.binary())])


def _flags(batches: Iterator[pa.RecordBatch], length: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, n, bytes) sorted by key; (key, digest, flags) of contexts with repeats leave, flags packed into bits."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        many: dict[int, int] = {}
        for key, *_ in rows:
            many[key] = many.get(key, 0) + 1
        # A context alone under its key that counts two or more repeats whole; the others meet in the suffix array.
        apart = [r for r in rows if many[r[0]] == 1 and r[2] > 1]
        meet = [r for r in rows if not (many[r[0]] == 1 and r[2] > 1)]
        found = [np.ones(len(r[3]) - length + 1, bool) for r in apart]
        for r, hit in zip(meet, repeated_starts([r[3] for r in meet], length, shard) if meet else []):
            found.append(hit | (r[2] > 1))
        keep = [(r[0], r[1], np.packbits(f).tobytes()) for r, f in zip(apart + meet, found) if f.any()]
        return pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in keep], pa.int64()), "digest": pa.array([r[1] for r in keep], pa.binary()), "flags": pa.array([r[2] for r in keep], pa.binary())})

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= shard and held[-1][0] != row[0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solve(held)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, n, bytes) of contexts; a row (key, digest, at, string, n) for each start, string being a hash of what starts there."""
    for batch in batches:
        for key, digest, n, held in zip(*(c.to_pylist() for c in batch.columns)):
            data = memoryview(held)
            strings = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(held) - length + 1)]
            m = len(strings)
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * m, pa.int64()), "digest": pa.array([digest] * m, pa.binary()), "at": pa.array(range(m), pa.int32()), "string": pa.array(strings, pa.binary()), "n": pa.array([n] * m, pa.int64())})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, starts) as (key, digest, flags)."""
    for batch in batches:
        flags = []
        for starts in batch.column(2):
            hit = np.zeros(CONTEXT, bool)
            hit[starts.values.to_numpy()] = True
            flags.append(np.packbits(hit).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.binary())], ["key", "digest", "flags"])


def _counted_flags(contexts: DataFrame, length: int) -> DataFrame:
    """(key, digest, flags) of the contexts (key, digest, n, bytes) that hold repeats: their strings are counted one by one."""
    strings = written(contexts.mapInArrow(lambda it: _strings(it, length), "key long, digest binary, at int, string binary, n long"), "strings")
    again = strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    hits = strings.join(again, "string").groupBy("key", "digest").agg(F.collect_list("at").alias("starts"))
    return hits.mapInArrow(_packed, "key long, digest binary, flags binary")


def _within(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, n, size, found) as (key, digest, flags): all starts of contexts that count two or more, else those found."""
    for batch in batches:
        flags = []
        for n, size, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            hit = np.full(size - length + 1, n > 1)
            if found.is_valid and n == 1:
                parts = found.values
                for start, f in zip(parts.field(0).to_pylist(), parts.field(1).to_pylist()):
                    hit[start + np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8)))] = True
            flags.append(np.packbits(hit).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.binary())], ["key", "digest", "flags"])


def _hot_flags(contexts: DataFrame, length: int, shard: int, hot: int, level: int, before: int) -> DataFrame:
    """(key, digest, flags) of the contexts (key, digest, n, bytes) of hot keys that hold repeats: contexts are filed once more, as texts."""
    half = lambda at: F.conv(F.hex(F.substring("digest", at, 8)), 16, -10).cast("long")
    contexts = written(contexts.select("key", "digest", "n", F.octet_length("bytes").alias("size"), "bytes", half(1).alias("k"), half(9).alias("fp")), "hot-contexts")
    found = _found(contexts.select("k", "fp", F.col("bytes").alias("text"), "n", F.col("key").alias("parent")), length, shard, hot, level, before)
    both = contexts.select("k", "fp", "key", "digest", "n", "size").join(found, ["k", "fp"], "left").where("n > 1 or found is not null")
    return both.select("key", "digest", "n", "size", "found").mapInArrow(lambda it: _within(it, length), "key long, digest binary, flags binary")


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The maximal removed stretches of each text."""
    for batch in batches:
        begins, ends = [], []
        for found in batch.column(2):
            parts = found.values
            starts = np.concatenate([s + np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8))) for s, f in zip(parts.field(0).to_pylist(), parts.field(1).to_pylist())])
            starts.sort()
            gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
            begins.append(starts[np.concatenate([[0], gap + 1])].tolist())
            ends.append((starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["k", "fp", "begins", "ends"])


def _found(texts: DataFrame, length: int, shard: int, hot: int, level: int = 0, before: int | None = None) -> DataFrame:
    """(k, fp, found): of each text with repeats the starts of contexts and flags of the starts in them.

    texts: k, fp (together a key), text, n (how often it counts) and parent (only texts of one parent are compared; of level 0, all).
    """
    filed = written(texts.select("k", "fp", "text", "parent").mapInArrow(lambda it: _file(it, length, level), "k long, fp long, start int, size int, key long, places int"), "contexts")
    again = filed.groupBy("key").agg(F.sum("places").alias("places")).where("places > 1").select("key")
    kept = filed.join(again, "key").groupBy("k", "fp").agg(F.collect_list(F.struct("start", "size", "key")).alias("places"))
    cut = texts.join(kept, ["k", "fp"]).select("k", "fp", "text", "places", "n").mapInArrow(lambda it: _cut(it, length), "k long, fp long, start int, size int, key long, digest binary, n long, bytes binary")
    cut = written(cut, "cut")
    # Dealt by key once; each partition has counted its own, so a common context comes at most twice from each.
    counted = cut.where("n > 0").select("key", "digest", "n", "bytes")
    held = counted.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("held"))
    large = written(held.where(F.col("held") > hot), "hot-keys")
    n_hot, now = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("held"), F.lit(0))).first()
    few = maybe_broadcast(large.select("key"), n_hot, BROADCAST_ROWS)
    rest = counted.join(few, "key", "left_anti") if n_hot else counted
    once = rest.repartition("key").groupBy("key", "digest").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
    flags = once.sortWithinPartitions("key").mapInArrow(lambda it: _flags(it, length, shard), "key long, digest binary, flags binary")
    if n_hot:
        contexts = counted.join(few, "key", "left_semi").groupBy("key", "digest").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
        on = level < LEVELS and (before is None or now <= LEFT * before)
        flags = flags.unionByName(_hot_flags(contexts, length, shard, hot, level + 1, now) if on else _counted_flags(contexts, length))
    flags = written(flags, "flags")
    hits = cut.where("k is not null").select("k", "fp", "start", "key", "digest").join(flags, ["key", "digest"])
    return hits.groupBy("k", "fp").agg(F.collect_list(F.struct("start", "flags")).alias("found"))


def repeated_spans(texts: DataFrame, length: int, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(k, fp, begins, ends): removed stretches of distinct texts; texts has k, fp (together a key) and text."""
    one = texts.select("k", "fp", "text", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("parent"))
    return _found(one, length, shard, hot).mapInArrow(lambda it: _spans(it, length), "k long, fp long, begins array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, on demand) of every row.

    Texts are UTF-8 bytes; null is empty.  Strings are judged on the input, so
    every one of several copies goes.  Texts shorter than length keep all.
    Rows that repeat an id are texts of their own.  Empty input gives no rows.
    shard: bytes of a suffix array; hot: bytes of a key's contexts that one task takes.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "text", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("fp"), F.octet_length("text").alias("n"))
    long = base.where(F.col("n") >= length)
    groups = long.groupBy("sha").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = written(groups, "copies")
    n = groups.count()
    shared = groups.select("sha", F.col("first"))
    distinct = long.join(maybe_broadcast(shared, n, BROADCAST_ROWS), "sha", "left").where("first is null or first = k").select("k", "fp", "text")
    spans = written(repeated_spans(distinct, length, shard, hot), "spans")
    copied = maybe_broadcast(groups.select("sha", "copies"), n, BROADCAST_ROWS)
    out = base.join(copied, "sha", "left").join(spans, ["k", "fp"], "left")
    whole = F.col("copies").isNotNull()
    begins = F.when(whole, F.array(F.lit(0))).otherwise(F.coalesce("begins", F.array().cast("array<int>")))
    ends = F.when(whole, F.array("n")).otherwise(F.coalesce("ends", F.array().cast("array<int>")))
    out = out.select("doc_id", "n", "sha", F.col("text").cast("binary").alias("raw"), begins.alias("begins"), ends.alias("ends"))
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0), lambda acc, x: acc + x)
    # What is left: the stretches between removed ones.
    left = F.zip_with(F.concat(F.array(F.lit(0)), F.col("ends")), F.concat(F.col("begins"), F.array("n")), lambda a, b: F.substring(F.col("raw"), a + 1, b - a))
    kept = F.when(F.size("begins") == 0, F.col("raw")).otherwise(F.aggregate(left, F.lit(b""), lambda acc, x: F.concat(acc, x)))
    sha = F.when(F.size("begins") == 0, F.col("sha")).otherwise(F.sha2(kept, 256))
    columns = ["doc_id", F.col("n").cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), sha.alias("kept_sha256")]
    return out.select(*columns, *([kept.alias("kept")] if with_text else []))
