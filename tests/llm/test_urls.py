"""URL rules and the classifier against plain Python versions."""

import math
import random

import xxhash
from helpers import SF01, read

from scorecard.llm import queries, url_filter

SCHEMA = "page_id bigint, url string, html string"


def parts(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def best_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def features(url):
    found = set()
    for name, text in zip(("host", "path"), parts(url)):
        chars = ["^", *(list(text) or [""]), "$"]
        for n in url_filter.GRAMS:
            for i in range(len(chars) - n + 1):
                h = 42
                for x in (name, *chars[i:i + n]):
                    h = xxhash.xxh64_intdigest(x.encode(), seed=h)
                found.add(h % url_filter.BUCKETS)  # a power of two: the sign is no matter
    return sorted(found)


def chance(found, w):
    m = sum(w[b] for b in found) / math.sqrt(max(len(found), 1)) + w[-1]
    return 1 / (1 + math.exp(-m))


def train(examples, steps=url_filter.STEPS):
    w, seen = [0.0] * (url_filter.BUCKETS + 1), [0.0] * (url_filter.BUCKETS + 1)
    rows = [(features(u), y) for u, y in examples]
    for _ in range(steps):
        g = [0.0] * len(w)
        for f, y in rows:
            e = y - chance(f, w)
            g[-1] += e
            for b in f:
                g[b] += e / math.sqrt(len(f))
        for b, x in enumerate(g):
            x /= len(rows)
            seen[b] += x * x
            if seen[b] > 1e-14:
                w[b] += url_filter.RATE * x / math.sqrt(seen[b])
    return w


def test_op11_whole_table(spark):
    got = queries.op11_url_filter(spark, SF01).collect()
    pages = {r[0]: r[1] for r in read(SF01, "pages")}
    assert len(got) == len(pages)
    ruled = {u: best_rule(*parts(u), queries.URL_RULES) for u in pages.values()}
    examples = sorted((u, int(b[2] == "block")) for u, b in ruled.items() if b and u)
    w = train(examples)
    for r in got:
        b = ruled[pages[r.page_id]]
        assert (r.host, r.path) == parts(pages[r.page_id])
        assert r.rule == (b[3] if b else None)
        p = chance(features(pages[r.page_id]), w)
        assert abs(r.probability - p) < 1e-4
        if b or abs(p - 0.5) > 1e-4:
            assert r.verdict == (b[2] if b else "block" if p > 0.5 else "allow")


TRICKY = [None, "", "no scheme", "://", "http://", "HTTP://A.Org", "http://a.org/", "http://org/x", "http://xorg/",
          "http://x.example.org/es/1?q#f", "http://EXAMPLE.ORG/en/12", "http://example.org/En/1", "a://b://c.org/d",
          "http://É.ORG/É", "http://u@a.com:80/de/1", "http://a.com?x=/fr/", "http://a.com/fr/\nx", "http://日本.com/fr/🙂",
          "http://" + "a." * 3000 + "org/" + "x/" * 50000]


def test_tricky_urls(spark):
    rows = [(i, u, None) for i, u in enumerate(TRICKY)] + [(None, "http://a.org/", "x"), (3, TRICKY[6], None)] * 2
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'x' AS host", "1 AS path", "'r' AS best", "'r' AS rule", "0.5 AS probability", "2 AS n_urls")
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    w = url_filter.fit_model(url_filter.labelled_by_rules(pages, rules))
    want = sorted(((i, *parts(u), best_rule(*parts(u), queries.URL_RULES)) for i, u, _ in rows), key=str)
    for inline in (100, 0):
        got = url_filter.judge(pages, rules, w, inline).collect()
        assert sorted(((r.page_id, r.host, r.path) for r in got), key=str) == sorted((x[:3] for x in want), key=str)
        assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(
            ((*x[:3], x[3] and x[3][3]) for x in want), key=str)
        assert all(r.verdict in ("allow", "block") and 0 <= r.probability <= 1 for r in got)


def test_many_rules_join_like_the_list(spark):
    rng = random.Random(3)
    hosts = ["a.b.c", "b.c", "c", "x.c", "d", "x.d"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/a/", "/a/b", "/b"]))
             for _ in range(30)]
    urls = [f"http://{rng.choice(hosts + ['y.a.b.c', 'bc', 'e'])}{rng.choice(['', '/', '/a', '/ab', '/a/b/c', '/b?x'])}"
            for _ in range(200)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA)
    for inline in (100, 3):
        got = url_filter.judge(pages, url_filter.rule_table(spark, rules), [0.0] * (url_filter.BUCKETS + 1), inline)
        for r in got.collect():
            b = best_rule(*parts(urls[r.page_id]), rules)
            assert (r.rule, r.verdict) == ((b[3], b[2]) if b else (None, "allow"))


def test_empty_tables(spark):
    pages = spark.createDataFrame([], SCHEMA)
    none = url_filter.rule_table(spark, [])
    w = url_filter.fit_model(url_filter.labelled_by_rules(pages, none))
    assert not any(w)
    assert url_filter.judge(pages, none, w).collect() == []
    assert url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES), w, 0).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/", None)], SCHEMA)
    assert [r.verdict for r in url_filter.judge(one, none, w).collect()] == ["allow"]


def test_no_python_on_executors(spark):
    plan = queries.op11_url_filter(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "MapIn", "ExistingRDD") if w in plan]
