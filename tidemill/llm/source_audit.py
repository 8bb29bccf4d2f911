"""How far the sources of a language diverge in their use of words.

Tasks count terms by (lang, source) and give counts, not words, to the shuffle.
Terms that enough documents of a language hold are dealt to chunks of the
vocabulary, and have a place there.  A group's counts in a chunk are packed
into one row.  Groups are dealt to blocks; each packed row goes to the tiles,
pairs of blocks, of its group's block, and a tile's task walks through its
chunks, one small matrix of counts at a time, and adds up the matrix of its
pairs.  Where a language has many chunks, a tile is cut into spans of chunks,
whose matrices are added in the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, written

#: Fixed value: a term, on UTF-8 bytes with A-Z lowered.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text whose terms are listed at once, and counts that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 200_000
#: Terms of a chunk, groups of a block, chunks of a span: bounds on average, as all are dealt by hash.
CHUNK, BLOCK, SPAN = 4096, 32, 64
#: The scale of a share, as a whole number.
SCALE = 1_000_000_000
_PARTS = "lang string, source string, term binary, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = _BETWEEN.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of documents by (lang, source, term); a null term for each group that occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (counts, holders) in held.items():
            lang += [a] * (len(counts) + 1)
            source += [b] * (len(counts) + 1)
            term += [None, *counts]
            n += [0, *counts.values()]
            docs += [0, *(holders[t] for t in counts)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(counts), set()
            for piece in _pieces(text.as_py().lower()):  # of bytes, lower() changes A-Z only
                terms = _TERM.findall(piece)
                counts.update(terms)
                seen.update(terms)
            holders.update(seen)
            size += len(counts) - before
            if size > HELD:
                yield rows()
                held, size = {}, 0
    yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often a term occurs in a group, and in how many of its documents; and a row with a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    parts = given.mapInArrow(_counted, _PARTS)
    whole = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return written(whole.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs"), "counts")


def vocabulary(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, total, chunk, place), and of each lang with any its (v, n)."""
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    terms = written(terms.select("lang", "term", "total"), "terms")
    langs = written(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n")), "langs")
    few = maybe_broadcast(langs.select(F.col("lang").alias("_lang"), F.ceil(F.col("v") / CHUNK).alias("chunks")), langs.count(), BROADCAST_ROWS)
    dealt = terms.join(few, F.col("lang") == F.col("_lang")).select("lang", "term", "total", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return written(dealt.select("*", place.alias("place")), "vocabulary"), langs


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact."""
    out = counts + 1
    if int(out.max(initial=0)) < _MOST // SCALE:
        return 1 + SCALE * out // (total + v)
    # Digit by digit, in base 1000, so that no product overflows.
    quotient, rest = out // (total + v), out % (total + v)
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // (total + v), rest * 1000 % (total + v)
    return 1 + quotient


_MOST = int(np.iinfo(np.int64).max)


def _tile(i: int, j: int, header: list[tuple], chunks: Iterator[list[tuple[str, np.ndarray, np.ndarray]]]) -> Iterator[tuple[str, str, int]]:
    """(source, item, value) of the pairs of the tile of blocks i and j over one span.

    header: (source, block, n, v, width of the span) of each group; chunks: of
    each chunk the groups' packed (source, places, counts).
    """
    groups = sorted(header, key=lambda h: (h[1] != i, h[0]))
    at = {h[0]: k for k, h in enumerate(groups)}
    n, v, width = [h[2] for h in groups], groups[0][3], groups[0][4]
    first = sum(h[1] == i for h in groups)
    twice = i != j  # all pairs across two blocks; else all inside one
    ours, theirs = (range(first), range(first, len(groups))) if twice else (range(first), range(first))
    value = np.zeros((len(groups), len(groups)), np.int64)

    def add(p: np.ndarray, times: int = 1) -> None:
        others = p[theirs.start : theirs.stop]
        for a in ours:
            gap = p[a] - others
            gap *= gap
            value[a, theirs.start : theirs.stop] += times * (gap // others).sum(axis=1)
            if twice:
                value[theirs.start : theirs.stop, a] += times * (gap // p[a]).sum(axis=1)

    for packed in chunks:
        size = 1 + max(int(places[-1]) for _, places, _ in packed)
        counts = np.zeros((len(groups), size), np.int64)
        for source, places, c in packed:
            counts[at[source], places] = c
        add(np.stack([shares(counts[i], n[i], v) for i in range(len(groups))]))
        width -= size
    if width:  # terms that no group of the tile has
        add(np.stack([shares(np.zeros(1, np.int64), n[i], v) for i in range(len(groups))]), width)
    for a in ours:
        for b in theirs:
            if a != b:
                yield groups[a][0], groups[b][0], int(value[a, b])
                if twice:
                    yield groups[b][0], groups[a][0], int(value[b, a])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, i, j, span), chunk, source, block, n, v, width, places, counts of each row; the header's chunk is -1."""
    for batch in batches:
        columns = [batch.column(i) for i in range(12)]
        plain = [c.to_pylist() for c in columns[:10]]
        for i in range(batch.num_rows):
            lang, ti, tj, span, chunk, source, block, n, v, width = (c[i] for c in plain)
            packed = (columns[10][i].values, columns[11][i].values) if chunk >= 0 else (None, None)
            yield (lang, ti, tj, span), chunk, source, block, n, v, width, *packed


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        key, header = row[0], []
        while row is not None and row[0] == key and row[1] < 0:
            header.append(row[2:7])
            row = next(rows, None)

        def chunks() -> Iterator[list]:
            nonlocal row
            while row is not None and row[0] == key:  # noqa: B023
                chunk, packed = row[1], []
                while row is not None and row[0] == key and row[1] == chunk:  # noqa: B023
                    packed.append((row[2], row[7].to_numpy(), row[8].to_numpy()))
                    row = next(rows, None)
                yield packed

        out = list(_tile(key[1], key[2], header, chunks()))
        source, item, value = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def _to_tiles(block: Column, blocks: Column) -> Column:
    """The tiles (i, j), i <= j, that need a block."""
    other = F.sequence(F.lit(0).cast("long"), blocks - 1)
    return F.transform(other, lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j")))


def pair_values(entries: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of groups of a lang.

    entries: lang, source, chunk, place, n of counts above 0; groups: lang,
    source, n, v of every group; terms: the vocabulary.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).withColumnRenamed("lang", "_lang")
    small = lambda df: maybe_broadcast(df, df.count(), BROADCAST_ROWS)
    dealt = groups.join(small(written(blocks, "blocks")), F.col("lang") == F.col("_lang")).select("lang", "source", "n", "v", "blocks", F.pmod(F.xxhash64("source"), "blocks").alias("block"))
    dealt = written(dealt, "dealt")
    span = F.floor(F.col("chunk") / SPAN)
    spans = written(terms.groupBy("lang", span.alias("span")).agg(F.count(F.lit(1)).alias("width")), "spans").withColumnRenamed("lang", "_lang")
    # Without a kept term there is one empty span.
    header = dealt.join(small(spans), F.col("lang") == F.col("_lang"), "left").select("lang", F.explode(_to_tiles(F.col("block"), F.col("blocks"))).alias("t"), F.coalesce("span", F.lit(0).cast("long")).alias("span"), F.lit(-1).cast("long").alias("chunk"), "source", "block", "n", "v", F.coalesce("width", F.lit(0).cast("long")).alias("width"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<long>").alias("counts"))
    at = F.array_sort(F.collect_list(F.struct("place", "n")))
    packed = entries.groupBy("lang", "source", "chunk").agg(at.alias("at")).select("lang", "source", "chunk", F.col("at.place").cast("array<int>").alias("places"), F.col("at.n").alias("counts"))
    known = dealt.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "n", "v", "blocks", "block")
    packed = packed.join(small(known), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))).select("lang", F.explode(_to_tiles(F.col("block"), F.col("blocks"))).alias("t"), span.alias("span"), "chunk", "source", "block", "n", "v", F.lit(0).cast("long").alias("width"), "places", "counts")
    rows = header.unionByName(packed).select("lang", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "span", "chunk", "source", "block", "n", "v", "width", "places", "counts")
    tiles = rows.repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: Column, total: Column, v: Column) -> Column:
    """shares() as an expression, in decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.call_function("div", (wide(count) + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(v)) + 1).cast("long")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Terms are runs of letters A-Z (lowered) and of characters beyond ASCII; a
    lang keeps those that least_docs of its documents hold.  A group's share
    of a kept term is p = 1 + floor(10**9 (count + 1) / (all counts + kept
    terms)).  Part `pair`: each other source of the lang, with the sum over
    kept terms of floor((p - q)**2 / q), q its share.  Part `term`: the kept
    terms of the group with p > q, q the whole lang's share, to rank `top`.
    Ranks go by value, larger first, then item by UTF-8 bytes.

    Null text, lang and source count as ''; texts without a term (empty ones
    too) still make a group.  Rows that repeat count as often as they come.
    Long texts are read in pieces.  An empty table gives an empty result.
    doc_id and other columns are not read.
    """
    counts = term_counts(docs)
    terms, langs = vocabulary(counts, least_docs)
    places = terms.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "total", "chunk", "place")
    entries = counts.where("term is not null").join(places, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term")))
    entries = written(entries.select("lang", "source", "term", "n", "total", "chunk", "place"), "entries")
    small = lambda df: maybe_broadcast(df, df.count(), BROADCAST_ROWS)
    sums = entries.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.sum("n").alias("n"))
    per_lang = small(langs.select(F.col("lang").alias("_l"), "v", F.col("n").alias("all_n")))
    zero = F.lit(0).cast("long")
    groups = counts.where("term is null").select("lang", "source").join(sums, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left").join(per_lang, F.col("lang") == F.col("_l"), "left")
    groups = written(groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("all_n", zero).alias("all_n")), "groups")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pair_values(entries.select("lang", "source", "chunk", "place", "n"), groups.select("lang", "source", "n", "v"), terms))
    own = small(groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("n").alias("own_n"), "v", "all_n"))
    both = entries.where("n > 0").join(own, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    both = both.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("all_n"), F.col("v")).alias("q")).where("p > q")
    said = ranked(both.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))).where(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(said.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
