"""The registered queries of the corpus operators, and their DuckDB SQL.

Each query applies its operator to whole tables and derives the columns of
the result from the operator's output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shared_dir, table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.sharding import kd_shards

    out = kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "neighbours")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.language_id import languages

    return languages(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.secrets import scan_version

    # A ledger of its own for each run: what the table holds is its first version.
    found = scan_version(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.piece_dropout import encode

    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "lossless")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.url_filters import filter_urls

    out = filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"), "confidence")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.source_audit import audit

    return audit(table(spark, sf_dir, "documents"))


_ALL = (op1_license_scans, op2_exact_dedup, op3_kd_sharding, op4_toxicity, op5_jaccard_join, op6_language_id, op7_secret_scans, op8_decontamination, op9_suffix_dedup, op10_piece_dropout, op11_url_rules, op12_hard_negatives, op13_source_audit)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _positions(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """SQL for the spans of one kind; pieces between matches give positions."""
    return f"""
      SELECT doc_id, {rank} AS r, '{kind}' AS kind, i,
             CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
             length(m[i]) AS n, length(g[i]) AS gn
      FROM (SELECT doc_id, m, g, parts, unnest(range(1, len(m) + 1)) AS i FROM (
              SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS parts
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
      WHERE length(g[i]) >= {least}"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: A-Z lowered and nothing else.
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_secret_scans": f"""
        WITH spans AS ({_positions("assign", _ASSIGN, 2, 8, 0)}
            UNION ALL {_positions("access", "AKIA[A-Z0-9]+", 0, 16, 1)}
            UNION ALL {_positions("hex", "[0-9a-f]+", 0, 32, 2)}),
        per AS (SELECT doc_id, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS c, count(*) FILTER (r = 2) AS h,
                       string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, r) AS spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN per USING (doc_id)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (
            SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: w[i:i+9])) AS x FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
        hits AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS x FROM places) JOIN win USING (n, x)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_url_rules": f"""
        WITH pages_ AS (SELECT page_id, url, coalesce({_LOWERED.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
                                              ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
        known AS (SELECT page_id, url, host, path, (SELECT max_by((rule, verdict), (length(rule), rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r,
            CASE WHEN contains(coalesce(url, ''), '://') THEN list_sort(list_distinct(list_concat(
                list_transform(list_filter([{_LOWERED.format("regexp_extract(url, '(?s)^(.*?)://', 1)")}], lambda x: x <> ''), lambda x: 'scheme:' || x),
                list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
                list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g')),
                list_transform(list_filter(list_transform(string_split(path, '/'), lambda x: regexp_extract(x, '^([0-9])', 1)), lambda x: x <> ''), lambda x: 'digit:' || x),
                list_transform(list_filter(list_transform(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '(?s)^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'query:' || x),
                list_transform(list_filter([regexp_extract(url, '(?s)^.*?://[^#]*#(.*)', 1)], lambda x: x <> ''), lambda x: 'fragment:' || x)))) ELSE [] END AS tokens FROM pages_),
        labelled AS (SELECT row_number() OVER () AS i, tokens, r[2] AS verdict FROM known WHERE r IS NOT NULL),
        totals AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'block') AS b FROM labelled),
        told AS (SELECT token, abs(c.b::HUGEINT * t.n - c.n::HUGEINT * t.b) AS gain FROM (SELECT token, count(*) AS n, count(*) FILTER (verdict = 'block') AS b FROM (SELECT unnest(tokens) AS token, verdict FROM labelled) GROUP BY token) c, totals t
                 WHERE c.n >= ceil(t.n * 0.02::DOUBLE) AND abs(c.b::HUGEINT * t.n - c.n::HUGEINT * t.b) > 0),
        items AS (SELECT i, verdict, list_sort(list_slice(list(token ORDER BY gain DESC, token), 1, 12)) AS told FROM (SELECT i, verdict, unnest(tokens) AS token FROM labelled) JOIN told USING (token) GROUP BY i, verdict),
        subsets AS (SELECT verdict, list_filter(told, lambda x, k: (m >> (k - 1)) & 1 = 1) AS combination FROM (SELECT verdict, told, unnest(range(1, 1::BIGINT << len(told))) AS m FROM items)),
        counted AS (SELECT combination, count(*) AS n, count(*) FILTER (verdict = 'block') AS block, count(*) FILTER (verdict = 'allow') AS allow FROM subsets GROUP BY combination),
        mined AS (SELECT combination, verdict, pages, pages / c.n::DOUBLE AS confidence FROM (SELECT combination, n, unnest(['block', 'allow']) AS verdict, unnest([block, allow]) AS pages FROM counted) c, totals t
                  WHERE pages >= ceil(t.n * 0.02::DOUBLE) AND pages / c.n::DOUBLE >= 0.8),
        pruned AS (SELECT * FROM mined m WHERE NOT EXISTS (SELECT 1 FROM mined o WHERE o.verdict = m.verdict AND len(o.combination) < len(m.combination) AND list_has_all(m.combination, o.combination) AND o.confidence >= m.confidence)),
        asked AS (SELECT DISTINCT tokens FROM known WHERE r IS NULL),
        best AS (SELECT tokens, arg_min((combination, verdict, confidence), (-confidence, -pages, combination, verdict)) AS m FROM asked JOIN pruned ON list_has_all(tokens, combination) GROUP BY tokens)
        SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], m[2], 'allow') AS verdict, array_to_string(m[1], ' ') AS mined, m[3] AS confidence
        FROM known LEFT JOIN best ON known.r IS NULL AND known.tokens = best.tokens""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""",
    "op13_source_audit": """
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT lang, source, doc_id, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(n, 0) AS own, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN langs USING (lang)),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, CAST(1 + 1000000000 * (coalesce(n, 0) + 1) // (own + v) AS BIGINT) AS p, CAST(1 + 1000000000 * (total + 1) // (all_n + v) AS BIGINT) AS q
              FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 200""",
}
