"""Exact deduplication by counting quotient filters.

Each input partition builds one counting quotient filter for every bucket of
the 64-bit fingerprints of its texts.  Under a bucket's leading bits the next
bits of a fingerprint (the quotient) name a run and the rest (the remainder)
is kept sorted in it, with a count.  As no bit is lost, the filters merge
exactly by merging sorted remainders run by run.  Fingerprints whose merged
count is above one are routed to byte verification; all others are known to
be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, text_key, without, written

#: Fingerprints of a merged bucket on average (some 7 bytes each in a filter).
PER_BUCKET = 2_000_000
#: Numbers that are packed at a time; a multiple of eight, so that pieces end on whole bytes.
PIECE = 1 << 16


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of numbers, end to end."""
    shifts = np.arange(width, dtype=np.uint64)
    return b"".join(np.packbits(((values[i : i + PIECE, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes() for i in range(0, len(values), PIECE))


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    out, shifts = np.zeros(n, np.uint64), np.arange(width, dtype=np.uint64)
    for i in range(0, n if width else 0, PIECE):
        m = min(PIECE, n - i)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-m * width // 8), i * width // 8), count=m * width)
        out[i : i + m] = (bits.reshape(m, width).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return out


@dataclass
class CountingQuotientFilter:
    """Distinct keys of `bits` bits with counts, packed.

    The quotient is the leading bits of a key, about as many as make one run
    for each key.  occupied has a bit for each quotient that has a run; the
    slots of all runs follow each other, sorted by remainder, and ends has a
    bit for each slot that ends a run.  many has a bit for each slot whose
    count is above one; the counts of those, less two, are packed at the width of the largest.
    """

    bits: int
    quotient_bits: int
    slots: int
    occupied: bytes
    ends: bytes
    remainders: bytes
    many: bytes
    counts_width: int
    counts: bytes

    @classmethod
    def from_sorted(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: distinct, in order."""
        n = len(keys)
        quotient_bits = min(bits - 1, 20, max(1, n.bit_length()))
        low = bits - quotient_bits
        quotients = (keys >> np.uint64(low)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.concatenate([quotients[1:] != quotients[:-1], np.ones(min(n, 1), bool)])
        many = counts > 1
        more = (counts[many] - 2).astype(np.uint64)
        width = int(more.max()).bit_length() if len(more) else 0
        bit = lambda x: np.packbits(x).tobytes()
        return cls(bits, quotient_bits, n, bit(occupied), bit(ends), pack(keys, low), bit(many), width, pack(more, width))

    @classmethod
    def build(cls, keys: np.ndarray, bits: int) -> CountingQuotientFilter:
        found, counts = np.unique(keys, return_counts=True)
        return cls.from_sorted(found, counts.astype(np.int64), bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and their counts."""
        n, flags = self.slots, lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        run = np.cumsum(flags(self.ends, n)) - flags(self.ends, n)  # the slot's run; runs belong to occupied quotients in order
        quotients = np.flatnonzero(flags(self.occupied, 1 << self.quotient_bits)).astype(np.uint64)[run]
        low = self.bits - self.quotient_bits
        counts, many = np.ones(n, np.int64), flags(self.many, n)
        counts[many] = unpack(self.counts, int(many.sum()), self.counts_width).astype(np.int64) + 2
        return (quotients << np.uint64(low)) | unpack(self.remainders, n, low), counts

    def count(self, key: int) -> int:
        keys, counts = self.items()
        at = int(np.searchsorted(keys, np.uint64(key)))
        return int(counts[at]) if at < len(keys) and int(keys[at]) == key else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs together."""
        return self.from_sorted(*merged([self.items(), other.items()]), self.bits)

    def row(self) -> tuple:
        return self.quotient_bits, self.slots, self.occupied, self.ends, self.remainders, self.many, self.counts_width, self.counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (keys, counts) of several filters as one: in pairs, so that each key is moved log(parts) times; counts of equal ones add up."""
    while len(parts) > 1:
        pairs = []
        for (mine, n), (theirs, m) in zip(parts[::2], parts[1::2]):
            at = np.searchsorted(mine, theirs)
            hit = at < len(mine)
            hit[hit] = mine[at[hit]] == theirs[hit]
            n = n.copy()
            n[at[hit]] += m[hit]
            pairs.append((np.insert(mine, at[~hit], theirs[~hit]), np.insert(n, at[~hit], m[~hit])))
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0]


_FILTER = pa.schema([("bucket", pa.int32()), ("quotient_bits", pa.int32()), ("slots", pa.int32()), ("occupied", pa.binary()), ("ends", pa.binary()), ("remainders", pa.binary()), ("many", pa.binary()), ("counts_width", pa.int32()), ("counts", pa.binary())])
_FILTER_SQL = "bucket int, quotient_bits int, slots int, occupied binary, ends binary, remainders binary, many binary, counts_width int, counts binary"


def _build(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """The partition's filters, one for each bucket that it has keys of."""
    seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
    if not seen or not (keys := np.concatenate(seen)).size:
        return
    keys, counts = np.unique(keys, return_counts=True)
    low = 64 - bucket_bits
    buckets = (keys >> np.uint64(low)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        held = CountingQuotientFilter.from_sorted(keys[a:b] & np.uint64((1 << low) - 1), counts[a:b].astype(np.int64), low)
        yield pa.RecordBatch.from_pylist([dict(zip(_FILTER.names, (int(buckets[a]), *held.row())))], _FILTER)


def _merge(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Filters come sorted by bucket; those of one bucket merge, and repeated fingerprints leave."""
    low = 64 - bucket_bits

    def repeated(bucket: int, parts: list[CountingQuotientFilter]) -> pa.RecordBatch:
        keys, counts = merged([p.items() for p in parts])
        many = counts > 1
        return pa.RecordBatch.from_pydict({"fp": pa.array((keys[many] | np.uint64(bucket << low)).view(np.int64)), "n": pa.array(counts[many])})

    current, parts = -1, []
    for batch in batches:
        for bucket, *fields in zip(*(col.to_pylist() for col in batch.columns)):
            if bucket != current and parts:
                yield repeated(current, parts)
                parts = []
            current = bucket
            parts.append(CountingQuotientFilter(low, *fields))
    if parts:
        yield repeated(current, parts)


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of each fingerprint that occurs more than once.

    :param fingerprints: one long column.
    :param rows: their number; sets the number of buckets.
    """
    bits = max(6, math.ceil(math.log2(max(1, rows / PER_BUCKET))))
    filters = fingerprints.mapInArrow(lambda it: _build(it, bits), _FILTER_SQL)
    return filters.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _merge(it, bits), "fp long, n long")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, text_sha256, keep_id, group_size, kept of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text_col).alias("fp"))
    repeated = written(repeated_fingerprints(base.select("fp"), docs.count()).select("fp"), "repeated-fingerprints")
    n = repeated.count()
    routed = base.join(maybe_broadcast(repeated, n, BROADCAST_ROWS), "fp", "left_semi")
    # Byte verification: the whole text is the grouping key.  Equal texts of a partition
    # collapse before the shuffle, so a text that fills the corpus moves once per partition.
    verified = routed.groupBy("fp", "text").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("times"))
    groups = verified.where("times > 1").select("fp", F.sha2("text", 256).alias("sha"), "keep", "times")
    joined = base.select("doc_id", "fp", F.sha2("text", 256).alias("sha")).join(maybe_broadcast(groups, n, BROADCAST_ROWS), ["fp", "sha"], "left")
    keep = F.when(F.col("times").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", "fp", F.col("sha").alias("text_sha256"), keep.alias("keep_id"), F.coalesce("times", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows of equal text; of each group the row with the largest id stays.

    Null text counts as the empty text, and all empty texts are one group.  A
    null id is less than any other; where a group has no other id, keep_id is
    null.  Rows that repeat the largest id of their group are all marked kept
    (drop_exact_copies leaves one).  Empty input gives no rows.  Other columns
    of docs are not read, whatever their names.

    Returns one row per input row: <id_col>, keep_id, group_size, kept, text_sha256.
    """
    return _groups(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each text, that of the largest doc_id (null is least); all columns stay.

    Of rows that repeat both doc_id and text any one stays.
    """
    groups = written(_groups(docs, "doc_id", "text").where("group_size > 1").select("doc_id", "fp", "kept"), "groups")
    repeated = groups.where("kept").groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return without(docs, groups.where("not kept"), repeated)
