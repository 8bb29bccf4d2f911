"""URL rules, hard negatives and the audit of sources, against brute force and on odd input."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from tidemill.llm import hard_negatives as hn
from tidemill.llm import source_audit as sa
from tidemill.llm import url_filters as uf
from tidemill.llm.common import table

# ---- url rules ----

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, tokens array<string>, token string, times long, best string, _t string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, "x", "h", "p", "r", "v", ["t"], "t", 1, "b", "t") for i, u in rows], PAGES)

    return make


def test_hosts_and_paths(spark):
    urls = {"http://A.Example.ORG/En/1?x#y": ("a.example.org", "/En/1"), "no scheme": ("", ""), "": ("", ""), "://h": ("h", ""), "x://h?q/p": ("h", ""), "x://h#f/p": ("h", ""), "s://É.com/ü\n/z?": ("É.com", "/ü\n/z"), "a://b://c/d": ("b:", "//c/d")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select("url", uf.host_of(F.col("url")), uf.path_of(F.col("url"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == urls


def test_longest_rule_wins_and_subdomains_count(pages):
    rows = [(1, "http://x.org/a"), (2, "http://www.example.org/es/1"), (3, "http://example.org/en/12"), (4, "http://notexample.org/en/12"), (5, "https://a.com/de/"), (6, "https://acom/de/"), (7, "http://x.org"), (8, "https://COM/fr/1")]
    got = {r.page_id: (r.rule, r.verdict) for r in uf.filter_urls(pages(rows)).collect()}
    assert got == {1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("example.org/en/1", "block"), 4: ("org/", "allow"), 5: ("com/de/", "block"), 6: (None, got[6][1]), 7: (None, got[7][1]), 8: ("com/fr/", "allow")}


def brute_rules(transactions, support, confidence):
    """All rules from a combination of tokens to a label, by counting every subset."""
    counts, both = Counter(), Counter()
    for items, label in transactions:
        for m in range(1, 1 << len(items)):
            c = tuple(x for i, x in enumerate(items) if m >> i & 1)
            counts[c] += 1
            both[c, label] += 1
    least = math.ceil(support * len(transactions))
    rules = {(c, label): (n / counts[c], n) for (c, label), n in both.items() if n >= least and n / counts[c] >= confidence}
    return {r: v for r, v in rules.items() if not any(o[1] == r[1] and len(o[0]) < len(r[0]) and set(o[0]) <= set(r[0]) and rules[o][0] >= v[0] for o in rules)}


def test_mined_rules_match_all_subsets(spark):
    known = table(spark, DATA, "pages")
    host, path = uf.host_of(F.col("url")), uf.path_of(F.col("url"))
    labelled = known.select(uf.url_tokens(F.col("url")).alias("tokens"), uf.listed_rule(host, path, uf.RULES)[1].alias("verdict")).where("verdict is not null")
    rows = [(r["tokens"], r["verdict"]) for r in labelled.collect()]
    n, blocked = len(rows), sum(v == "block" for _, v in rows)
    has, bad = Counter(t for ts, _ in rows for t in ts), Counter(t for ts, v in rows if v == "block" for t in ts)
    gain = {t: abs(bad[t] * n - has[t] * blocked) for t in has if has[t] >= math.ceil(n * uf.SUPPORT)}
    items = [(sorted(sorted((t for t in ts if gain.get(t)), key=lambda t: (-gain[t], t))[: uf.TELLING]), v) for ts, v in rows]
    got = {(tuple(r.combination), r.verdict): (r.confidence, r.pages) for r in uf.mined_rules(labelled).collect()}
    assert got == brute_rules(items, uf.SUPPORT, uf.CONFIDENCE) and got


def test_mined_rules_decide_other_hosts(pages):
    # What rules say of paths under .com and .org carries over to .net, where none is listed.
    rows = [(i, f"https://s{i % 7}.example.{tld}/{lang}/{i}") for i, (tld, lang) in enumerate((t, x) for t in ("com", "net") for x in ("de", "fr") for _ in range(30))]
    out = {r.page_id: r for r in uf.filter_urls(pages(rows)).collect()}
    for i, url in rows:
        assert out[i].verdict == ("block" if "/de/" in url else "allow"), url
        assert (out[i].rule is None) == (".net/" in url) and (out[i].mined is None) == (".com/" in url)
    assert next(r for r in out.values() if r.mined and r.verdict == "block").confidence == 1.0
    assert {r.page_id for r in uf.blocked(pages(rows)).collect()} == {i for i, u in rows if "/de/" in u}


def test_labels_can_be_given(spark, pages):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.net/p{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, "block" if i % 3 == 0 else "allow") for i in range(30)] + [(40, None), (41, "?")], "page_id long, verdict string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(pages(rows), rules=[], labels=labels).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(60)}


def test_odd_urls(pages):
    rows = [(1, None), (2, ""), (3, "no url"), (3, "no url"), (None, "http://x.org/"), (None, "http://x.org/"), (4, "http://a.net/" + "x/" * 20_000), (5, "http://a.net/" + "y" * 200_000), (6, "://"), (7, "http:///?#")]
    got = uf.filter_urls(pages(rows)).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in rows)
    assert {(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id in (1, 2, 3)} == {("", "", None, "allow")}
    assert max(len(r.path) for r in got) == 200_001
    assert uf.filter_urls(pages([])).collect() == []


# ---- hard negatives ----

ROWS = "vec_id long, embedding array<float>, label int, vector string, block string, id long, list long, score long, rank int"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, y, "v", "b", 1, 2, 3, 4) for i, v, y in rows], ROWS)

    return make


def brute_negatives(rows, positives=5, negatives=3):
    known = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), (y + 1) % 10 if i % 7 == 0 else y))
    out = set()
    for a, v, y in set(known):
        if a % 50:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: B023, E731
        near = sorted({(-score(w), i) for i, w, z in known if z == y and i != a and len(w) == len(v)})[:positives]
        far = sorted({(-score(w), i) for i, w, z in known if z != y and i != a and len(w) == len(v)})
        for s, i in near:
            hits = [(t, j) for t, j in far if 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out |= {(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(hits)}
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_match_brute_force(spark):
    rows = [tuple(r) for r in table(spark, DATA, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in hn.hard_negatives(table(spark, DATA, "embeddings")).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows) and got


def test_hard_negatives_in_small_blocks_and_slices(spark, vectors, monkeypatch):
    rng = np.random.default_rng(5)
    # Many ties: small whole numbers, and one vector that a third of the rows share.
    rows = [(i, [1.0, 2.0, 1.0] if i % 3 == 0 else (rng.integers(0, 4, 3) / 2).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    monkeypatch.setattr(hn, "BLOCK_BYTES", 3 * 8 * 2)
    monkeypatch.setattr(hn, "SCORES", 40)
    got = [tuple(r) for r in hn.hard_negatives(vectors(rows).repartition(7)).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_hard_negatives_on_odd_rows(vectors):
    rows = [(50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (50, [0.5, 1.0], 2), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.25], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (8, [1.0, 0.2], None), (None, [1.0, 1.0], 1), (9, [1.0, 0.2, 3.0], 2), (10, [], 1), (100, [], 1), (11, [0.75, 0.0], 2), (12, [1.0, -0.5], 1), (150, [0.0, 0.0], 3), (13, [0.0, 0.0], 3)]
    got = [tuple(r) for r in hn.hard_negatives(vectors(rows)).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows) and got
    assert hn.hard_negatives(vectors([])).collect() == [] and hn.hard_negatives(vectors(rows[3:5])).collect() == []


def test_scores_are_exact_beyond_double_precision():
    rng = np.random.default_rng(1)
    for most in (2**20, 2**28, 2**40):
        a, b = rng.integers(-most, most, (3, 5)).astype(float), rng.integers(-most, most, (4, 5)).astype(float)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert hn.scores(a, b).tolist() == [[max(-(2**63) + 1, min(2**63 - 1, x)) for x in r] for r in want]
    assert hn.scores(np.full((1, 2), 1e300), np.array([[1.0, 0.0], [-1.0, -1.0], [0.0, 0.0]])).tolist() == [[2**63 - 1, -(2**63) + 1, 0]]


# ---- audit of sources ----


def brute_audit(rows, top=200, least=3):
    """rows: (lang, source, text)."""
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = defaultdict(Counter)
        for _, source, ts in own:
            count[source].update(t for t in ts if docs[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share(sum(count.values(), Counter())), {s: share(c) for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            own_terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", own_terms, top)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def documents(spark, rows):
    schema = "doc_id long, lang string, source string, text string, n long, term string, chunk long, block long, _lang string, v long, value long"
    return spark.createDataFrame([(i, *r, 1, "t", 2, 3, "l", 4, 5) for i, r in enumerate(rows)], schema)


def collected(df):
    got = [tuple(r) for r in df.select(*AUDIT).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sizes", [(4096, 32, 64), (3, 2, 2)])
def test_audit_matches_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("CHUNK", "BLOCK", "SPAN"), sizes):
        monkeypatch.setattr(sa, name, n)
    monkeypatch.setattr(sa, "PIECE", 50)
    monkeypatch.setattr(sa, "HELD", 20)
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "gamma", "ÉCLAIR", "naïve", "日本", "don't", "x1y", "Zeta", "eta", "omega", "😀", "iota"]
    rows = [(("en", "de", None, "")[rng.integers(0, 4)], f"s{rng.integers(0, 7)}", " ".join(rng.choice(words, rng.integers(0, 30)))) for _ in range(150)]
    assert collected(sa.audit(documents(spark, rows).repartition(5))) == brute_audit(rows)


def test_audit_on_odd_rows(spark):
    rows = [(None, None, None), ("", "", ""), ("en", "a", "only two"), ("en", "b", "only two"), ("en", "empty", "12 3"), ("fr", "x", "un un deux"), ("fr", "x", "un un deux"), ("fr", "y", "un"), ("fr", None, "un deux trois"), ("fr", "long", "deux " * 300_000 + "w" * 1_500_000)]
    got = collected(sa.audit(documents(spark, rows)))
    assert got == brute_audit(rows)
    assert {r[:4] + r[4:5] for r in got if r[0] == "en"} == {("en", s, "pair", o, 0) for s in ("a", "b", "empty") for o in ("a", "b", "empty") if s != o}
    assert sa.audit(documents(spark, [])).collect() == []


def test_shares_stay_exact_for_large_counts():
    counts = np.array([0, 1, 2**33, 10**13, 3 * 10**14], np.int64)
    total, v = int(counts.sum()), 5
    assert sa.shares(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 1) // (total + v) for c in counts]


def test_no_token_of_a_page_is_left_out_of_the_mining(spark):
    # Twelve tokens tell more than x and y, which decide only together.
    rows = []
    for i in range(400):
        block = i % 2 == 0
        marks = [f"t{k:02}" for k in range(12) if (i * 7 + k) % 20 < (19 if block else 1)] if i >= 80 else [f"t{k:02}" for k in range(12)]
        both = block if i < 80 else False
        rows.append((sorted(marks + (["x", "y"] if both else ["x"] if i % 3 == 0 else ["y"])), "block" if block else "allow"))
    got = {(tuple(r.combination), r.verdict): (r.confidence, r.pages) for r in uf.mined_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert got[("x", "y"), "block"] == (1.0, 40)
    assert not any({"x", "y"} < set(c) for c, v in got if v == "block")
