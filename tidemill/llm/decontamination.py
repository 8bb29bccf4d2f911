"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A window is the set of its word shingles with
their places.  A document contains the window only if it contains every one of its
shingles, so any single shingle is a necessary prefix.  Shingles of windows
are counted over the whole corpus; then only the rarest one of each window is
joined.  Its place bounds where the window would have to start and end
(positional and length bounds), and the words there are compared exactly.
All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import maybe_broadcast, text_key, without, written

#: Fixed value: what separates words, once A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many shingles (a number of 8 bytes each) and candidates' documents are broadcast; beyond, joins shuffle.
BROADCAST_TOKENS, BROADCAST_DOCS = 1_000_000, 200_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _shingles(ws: Column, k: int) -> Column:
    """Hashes of k consecutive words, for every place; they serve to find places, which are then compared by words."""
    n = F.size(ws) - (k - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + j) for j in range(k)]))


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp (which together tell texts apart) and words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("fp"), words(F.col("text")).alias("w"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, words of one window."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, window))).alias("words"))


def _candidates(docs: DataFrame, prefix: DataFrame, tokens: int, k: int, window: int) -> DataFrame:
    """doc_id, fp, window, start, n, words_there for places of a prefix shingle where its window fits into the document."""
    # posexplode_outer, as a plain one would have the optimizer test every array first, with the words split anew for every place.
    shingled = docs.withColumn("tokens", _shingles(F.col("w"), k))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if tokens <= BROADCAST_TOKENS:
        # The words stay where they are until a place is found: one stage from the shingles to the comparison.
        placed = shingled.select("doc_id", "fp", "w", F.size("w").alias("n_words"), F.posexplode_outer("tokens").alias("pos", "token"))
        met = placed.join(F.broadcast(prefix), "token").where(fits)
        return met.select("doc_id", "fp", "window", start.alias("start"), "n", F.slice("w", start + 1, F.col("n")).alias("there"))
    placed = shingled.select("doc_id", "fp", F.size("w").alias("n_words"), F.posexplode_outer("tokens").alias("pos", "token"))
    met = placed.join(prefix, "token").where(fits).select("doc_id", "fp", F.struct("window", start.alias("start"), "n").alias("place"))
    met = written(met.groupBy("doc_id", "fp").agg(F.collect_set("place").alias("places")), "places")
    own = met.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "places")
    found = docs.join(maybe_broadcast(own, met.count(), BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    there = F.transform("places", lambda p: F.struct(p["window"].alias("window"), p["start"].alias("start"), p["n"].alias("n"), F.slice(F.col("w"), p["start"] + 1, p["n"]).alias("there")))
    return found.select("doc_id", "fp", F.inline(there))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Every place where a window occurs: doc_id, fp (text_key), start (0-based word), n (words), item_id.

    Null, empty and wordless texts and items give no places.  Equal windows of
    several items give one row each.  Rows are told apart by doc_id and text;
    rows that repeat both give their places again.
    """
    none = docs.sparkSession.createDataFrame([], f"doc_id long, fp long, start int, n int, item_id {dict(benchmark.dtypes)['item_id']}")
    windows = benchmark_windows(benchmark, window).groupBy("words").agg(F.collect_set("item_id").alias("items"))
    windows = written(windows.select(F.xxhash64("words").alias("window"), "words", "items", F.least(F.size("words"), F.lit(shingle)).alias("k")), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most `shingle` values
    docs, found = _documents(docs), none.select("doc_id", "fp", "start", "n", "item_id")
    for k in lengths:
        own = windows.where(F.col("k") == k).withColumn("tokens", _shingles(F.col("words"), k))
        placed = written(own.select("window", F.size("words").alias("n"), F.posexplode("tokens").alias("offset", "token")), "window-shingles")
        # How often the shingles of windows occur in the corpus.
        tokens = written(placed.select("token").distinct(), "tokens")
        n_tokens = tokens.count()
        there = docs.select(_shingles(F.col("w"), k).alias("tokens")).select(F.explode_outer("tokens").alias("token"))
        if n_tokens <= BROADCAST_TOKENS:
            frequency = there.join(F.broadcast(tokens), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        else:
            frequency = there.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(tokens, "token")
        frequency = written(frequency, "frequencies")
        # A window with a shingle that is nowhere in the corpus cannot occur; of the others the rarest shingle is the prefix.
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("df").asc_nulls_first(), "offset"))
        prefix = placed.join(frequency, "token", "left").withColumn("r", rank).where("r = 1 and df is not null")
        prefix = written(prefix.select("token", "window", "offset", "n"), "prefix")
        met = _candidates(docs, prefix, prefix.count(), k, window)
        met = written(met, "candidates")
        known = own.select("window", "words", "items")
        hits = met.join(maybe_broadcast(known, n_tokens, BROADCAST_TOKENS // 10), "window").where(F.col("there") == F.col("words"))
        found = found.union(hits.select("doc_id", "fp", "start", "n", F.explode("items").alias("item_id")))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of any window in the row's own
    text, whatever other rows share its doc_id, and also without one.  Null
    and empty texts have no words.  An empty benchmark, or one without words,
    hits nothing.
    """
    hits = written(benchmark_hits(docs, benchmark, window, shingle), "hits")
    places = hits.select("doc_id", "fp", "start", "n").distinct()
    hit = places.select("doc_id", "fp", F.explode(F.expr("sequence(start, start + n - 1)")).alias("at")).distinct().groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hit = hit.select(F.col("doc_id").alias("_i"), F.col("fp").alias("_f"), "n_hit")
    per_doc = items.join(hit, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("fp") == F.col("_f"))).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "n_hit", "ids")
    base = _documents(docs).select("doc_id", "fp", F.size("w").cast("long").alias("n_words"))
    out = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that a window of the benchmark occurs in; all columns stay.  Rows are judged by their own text, with or without a doc_id."""
    return without(docs, benchmark_hits(docs, benchmark, window))
