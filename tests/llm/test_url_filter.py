from pyspark.sql import functions as F

from metrolith.llm import url_filter
from metrolith.llm.queries import RULES


def brute(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "block" if host in listed else "allow"


URLS = [
    "http://Blog.Example.NET/en/1", "http://example.net/de/1", "https://net/x", "http://net", "http://xnet/", "https://a.example.com/de/9?x=1", "https://a.example.com/fr/?utm_source=1",
    "https://b.org/fr/a#b", "https://b.org/frx", "b.org/fr/", "", None, "x://", "http://É.ORG?utm_=1", "http://é.org/x", "http://u:p@h.net:80/en/", "a\n://h.org/q\n/z", "http://x://y/z", "http://h.org#/fr/", "http://a.com//de/",
] + [f"http://h{i}.example.org/p{i}{'?utm_x' if i % 3 == 0 else ''}" for i in range(400)]


def judged(spark, **kw):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[5], "h")], "page_id long, url string, host string")
    return url_filter.judge(pages, RULES, F.col("url").contains("utm_"), **kw)


def test_matches_brute_force(spark):
    listed = {brute(u, set())[0] for u in URLS if u and "utm_" in u}
    for kw in ({}, {"max_bytes": 8}, {"max_bytes": 64}):  # one filter for each level, and many shards
        got = judged(spark, **kw).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            u = URLS[r.page_id] if r.page_id is not None else URLS[5]
            assert (r.host, r.path, r.rule, r.verdict) == brute(u, listed), u


def test_cascade_is_exact_and_joins_nothing(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 17 == 0).alias("on"))
    for most, shards in ((1 << 20, 1), (16, 9)):
        c = url_filter.cascade(keys, "key", F.col("on"), bits_per_key=3, hashes=2, max_bytes=most)
        assert len(c.levels) >= 3 and c.shards == shards
        assert c.with_listed(keys, "key", "got").where("on <> got").count() == 0
    plan = judged(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, RULES, F.col("url").contains("utm_"), max_bytes=8).collect() == []
    assert url_filter.judge(none, RULES, F.col("url").contains("utm_")).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, RULES, F.lit(None).cast("boolean")).collect()] == [(1, "a.org", "/", None, "allow")]
