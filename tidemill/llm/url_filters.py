"""URL filters by association rules, in DataFrame functions and Spark's FP-growth.

Some pages are labelled: by a list of rules on host and path, or by a table of
labels.  FP-growth mines the combinations of URL tokens that go with a label;
rules from a combination to a label are pruned by support and confidence, and
those that a shorter rule makes superfluous go.  A rule is posted under the
rarest token of its combination in an inverted index; a page meets only the
rules posted under its own tokens, and what it meets is compared in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, maybe_broadcast, written

#: Least share of labelled pages that hold a combination and its label, and least confidence of a rule.
SUPPORT, CONFIDENCE = 0.02, 0.8
#: So many tokens of a labelled URL, the most telling, enter the mining; None: all of them.
TELLING = None
#: What a page is that neither a listed nor a mined rule decides.
DEFAULT = "allow"
#: The listed rules (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Fixed values of the digits' place holder and of the labels among the tokens.
_LABEL = "label:"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; empty for null or without `://`."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> Column:
        at = rule.index("/")
        return ((host == rule[:at]) | F.endswith(host, F.lit(f".{rule[:at]}"))) & F.startswith(path, F.lit(rule[at:]))

    one = [F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, rule in longest]
    found = F.coalesce(*one) if one else F.lit(None).cast("struct<rule:string,verdict:string>")
    return found["rule"], found["verdict"]


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: scheme, labels of the host, parts of the path (runs of digits as `0`, and
    the digit they begin with), names of query parameters, fragment.  None for null or without `://`."""
    said = F.coalesce(url, F.lit(""))
    named = lambda name, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{name}:"), x))
    scheme = F.array(_lower(F.regexp_extract(said, r"(?s)^(.*?)://", 1)))
    parts = F.split(path_of(url), "/")
    digits = F.transform(parts, lambda x: F.regexp_extract(x, r"^([0-9])", 1))
    after = F.regexp_extract(said, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(after, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    fragment = F.array(F.regexp_extract(said, r"(?s)^.*?://[^#]*#(.*)", 1))
    every = F.concat(named("scheme", scheme), named("host", F.split(host_of(url), r"\.")), named("path", F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "0"))), named("digit", digits), named("query", names), named("fragment", fragment))
    return F.when(F.contains(said, F.lit("://")), F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def frequent_tokens(labelled: DataFrame) -> DataFrame:
    """token, n and b (labelled pages that have it, blocked ones among them), all_n: of the tokens that are frequent and tell something.

    labelled: tokens, verdict (allow or block).  A token tells nothing if the
    blocked pages that have it are as many as is to be expected.
    """
    counts = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").cast("int").alias("blocked")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"))
    totals = labelled.agg(F.count(F.lit(1)).alias("all_n"), F.count_if(F.col("verdict") == "block").alias("all_b"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # A token of too few pages is in no frequent combination.
    found = counts.join(F.broadcast(totals), F.lit(True)).where((F.col("n") >= F.ceil(F.col("all_n") * F.lit(SUPPORT))) & (wide("b") * wide("all_n") != wide("n") * wide("all_b")))
    return found.select("token", "n", "b", "all_n")


def transactions(labelled: DataFrame, tokens: DataFrame) -> DataFrame:
    """items of each labelled page: those of its tokens that are among the given (token), and its label."""
    one = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "verdict", F.explode_outer("tokens").alias("token"))
    # Frequent tokens: at most the mean number of tokens over SUPPORT, whatever the input's size.
    held = one.join(maybe_broadcast(tokens.select("token", F.lit(True).alias("told")), tokens.count(), BROADCAST_ROWS), "token", "left").groupBy("row", "verdict").agg(F.array_sort(F.collect_list(F.when(F.col("told"), F.col("token")))).alias("items"))
    return held.select(F.concat("items", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))


def mined_rules(labelled: DataFrame) -> DataFrame:
    """combination (sorted tokens), verdict, confidence, pages (that hold both): what FP-growth finds in labelled (tokens, verdict).

    A rule stays if its support and confidence suffice and no rule for the same verdict on a part of its tokens is at least as sure.

    All frequent tokens of a page count.  A token that only pages of one label
    have is a rule that no longer one with it can surpass, so it stays out of
    the mining, which loses no rule and leaves fewer combinations.
    """
    schema = "combination array<string>, verdict string, confidence double, pages long"
    labelled = written(labelled.select("tokens", "verdict"), "labelled")
    tokens = written(frequent_tokens(labelled), "telling")
    sure = (F.col("b") == 0) | (F.col("b") == F.col("n"))
    items = written(transactions(labelled, tokens.where(~sure)), "transactions")
    n = items.count()
    if not n:
        return labelled.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in schema.split(", "))])
    model = FPGrowth(itemsCol="items", minSupport=SUPPORT, minConfidence=CONFIDENCE, predictionCol="said").fit(items)
    found = model.associationRules.select(F.array_sort("antecedent").alias("combination"), F.element_at("consequent", 1).alias("said"), "confidence", F.round(F.col("support") * n).cast("long").alias("pages"))
    # The label is never part of a combination.
    found = found.where(F.startswith("said", F.lit(_LABEL)) & ~F.exists("combination", lambda x: F.startswith(x, F.lit(_LABEL)))).select("combination", F.substr("said", F.lit(len(_LABEL) + 1)).alias("verdict"), "confidence", "pages")
    alone = tokens.where(sure).select(F.array("token").alias("combination"), F.when(F.col("b") == 0, "allow").otherwise("block").alias("verdict"), F.lit(1.0).alias("confidence"), F.col("n").alias("pages"))
    found = written(found.unionByName(alone), "rules")
    rules = found.select("*", F.concat_ws("\n", "combination").alias("rule"))
    part = rules.select(F.explode("combination").alias("token"), F.col("rule").alias("shorter"), F.col("combination").alias("less"), F.col("confidence").alias("sure"), F.col("verdict").alias("same"))
    # Parts are found as pages find their rules: by the first token of the part.
    part = part.where(F.col("token") == F.element_at("less", 1))
    whole = rules.select("rule", "combination", "verdict", "confidence", F.explode("combination").alias("token"))
    within = (F.size("less") < F.size("combination")) & (F.size(F.array_except("less", "combination")) == 0) & (F.col("sure") >= F.col("confidence")) & (F.col("same") == F.col("verdict"))
    over = whole.join(part, "token").where(within).select("rule", "verdict").distinct()
    return written(rules.join(over, ["rule", "verdict"], "left_anti").select("combination", "verdict", "confidence", "pages"), "rules")


def inverted_index(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """token, combination, verdict, confidence, pages: each rule under the rarest token of its combination; seen: tokens of pages."""
    counts = seen.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.select("*", F.explode("combination").alias("token")).join(counts, "token", "left")
    rarest = posted.groupBy("combination", "verdict").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("confidence").alias("confidence"), F.first("pages").alias("pages"))
    return rarest.select("token", "combination", "verdict", "confidence", "pages")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (combination of the mined rule that decided), confidence of every page.

    rules: (verdict, host and path); the longest that fits decides.  Pages
    that no rule decides get the verdict of the surest mined rule that their
    tokens hold, of equally sure ones that of most pages, then the least by
    combination and verdict; pages without any are allowed.

    labels: page_id and verdict of labelled pages.  Without it the pages that
    a listed rule decides are the labelled ones.  Labels that are null or
    neither allow nor block are left out; a page with both is labelled twice.

    Null urls and urls without `://` have an empty host and path, no tokens,
    and are allowed.  Long urls are read whole.  Rows that repeat page_id and
    url stay as often as they come; null ids are ids.  An empty table gives an
    empty result.  Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = listed_rule(host, path, RULES if rules is None else rules)
    known = rows.select("page_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("said"), url_tokens(F.col("url")).alias("tokens"))
    if labels is None:
        labelled = known.where("said is not null").select("tokens", F.col("said").alias("verdict"))
    else:
        given = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("verdict").cast("string").alias("verdict")).where(F.col("verdict").isin("allow", "block")).distinct()
        labelled = known.join(given, "page_id").select("tokens", "verdict")
    index = written(inverted_index(mined_rules(labelled), known), "index")
    index = maybe_broadcast(index.select(*[F.col(c).alias(f"_{c}") for c in index.columns]), index.count(), BROADCAST_ROWS)
    # One row a page that counts it, and one for each token; both go into one group.
    asked = known.select("page_id", "url", "tokens", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("said").isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>")))).alias("_t"))
    met = asked.join(index, F.col("_t") == F.col("_token"), "left")
    holds = F.col("_combination").isNotNull() & (F.size(F.array_except("_combination", "tokens")) == 0)
    rank = F.struct((-F.col("_confidence")).alias("sure"), (-F.col("_pages")).alias("often"), F.col("_combination").alias("combination"), F.col("_verdict").alias("verdict"))
    best = met.groupBy("page_id", "url").agg(F.count_if(F.col("_t").isNull()).alias("times"), F.min(F.when(holds, rank)).alias("best"))
    each = best.select("page_id", "url", "best", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_n"))
    out = each.select("page_id", "best", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("said"))
    verdict = F.coalesce("said", "best.verdict", F.lit(DEFAULT))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("best.combination").alias("mined"), (-F.col("best.sure")).alias("confidence"))


def blocked(pages: DataFrame, **options) -> DataFrame:
    """page_id of the pages that are blocked."""
    return reduce(lambda df, c: df.drop(c), ["host", "path", "rule", "mined", "confidence"], filter_urls(pages, **options).where("verdict = 'block'")).select("page_id")
