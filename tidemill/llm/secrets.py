"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a document is a blob, addressed by the SHA-256 of its text.
The ledger holds (blob, rule_version, findings) of what was scanned before.
A scan looks only at pairs of blob and rule version that the ledger lacks,
each once, and joins the findings back to every path (row) with that blob.
All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import written

#: The kinds in their order, the pattern of each, the group that is measured and its least length.
RULES = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run is matched whole, so short runs need not be listed to be dropped
]
RULE_VERSION = "base-1"
FINDING = "struct<start:int,rank:int,kind:string,end:int>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of the pattern's leftmost matches, in code points.

    The pieces between matches and the matches themselves tile the text, so
    running sums of their lengths are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    tiles = F.arrays_zip(found.alias("m"), measured.alias("g"), F.slice(gaps, 1, F.size(found)).alias("p"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["p"])
        end = start + F.length(t["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(t["g"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FINDING}>").alias("spans"))
    spans = F.aggregate(tiles, zero, step, lambda acc: acc["spans"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{FINDING}>"))


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the blob's address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan_blobs(paths: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks: (blob, rule_version, findings), one row per new blob.

    Only one path of each blob carries its text to the scan.
    """
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        todo = todo.join(seen, "blob", "left_anti")
    todo = todo.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"))
    texts = paths.join(todo, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("blob") == F.col("_blob")), "left_semi")
    found = F.array_sort(F.concat(*[_matches(F.col("text"), pattern, group, least, rank, kind) for rank, (kind, pattern, group, least) in enumerate(RULES)]))
    scanned = texts.select("blob", F.lit(rule_version).alias("rule_version"), found.alias("findings"))
    return scanned.dropDuplicates(["blob", "rule_version"])  # rows that repeat doc_id and text


def _join_back(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Findings (blob, findings) joined to all rows with that blob: doc_id, blob, findings."""
    hits = known.where(F.size("findings") > 0).groupBy("blob").agg(F.max("findings").alias("findings"))
    return paths.select("doc_id", "blob").join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row: doc_id, blob, findings (sorted by start, then kind).

    Null text is the empty text; rows with equal text share one scan; a blob
    that the ledger has under this rule version is not scanned again and takes
    the ledger's findings.  Empty input gives no rows; extra columns are not
    read.
    """
    paths = blobs(docs)
    # Written, so that only the chosen paths' texts are scanned, and that once.
    known = written(scan_blobs(paths, ledger, rule_version), "ledger").select("blob", "findings")
    if ledger is not None:
        known = known.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob", "findings"))
    return _join_back(paths, known)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """blob, rule_version, findings of all scans that were kept in a folder; none if nothing was."""
    schema = f"blob string, rule_version string, findings array<{FINDING}>"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_version(docs: DataFrame, folder: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """scan_secrets of one version of a table, with a ledger that is kept in a folder.

    Only pairs of blob and rule version that no earlier version had are
    scanned; they are added to the ledger.  A scan that fails adds nothing, or
    rows that the next one finds and leaves out.  Null texts count as empty
    ones; rows that repeat, or share a text, share one blob and all get its
    findings.  Texts are scanned whole.  An empty table adds nothing; columns
    besides doc_id and text are not read.
    """
    paths = blobs(docs)
    scan_blobs(paths, read_ledger(docs.sparkSession, folder), rule_version).write.mode("append").option("compression", "zstd").parquet(folder)
    known = read_ledger(docs.sparkSession, folder).where(F.col("rule_version") == rule_version)
    return _join_back(paths, known)
