"""URL filters: longest-rule verdicts, and exact list membership by a cascade of Bloom filters.

Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.io import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and every subdomain if the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def url_host(url: Column | str) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lowered; '' for null or no ://."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column | str) -> Column:
    """What follows the host, up to ?, # or the end; '' for null or no ://."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls. Rules are few: they are part of the plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones stand further out and win
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: Column, bits: int, hashes: int) -> list[Column]:
    h = F.xxhash64(level, key)
    first, step = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [F.pmod(first + step * F.lit(i), F.lit(bits)) for i in range(hashes)]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.hash(F.lit("shard"), key), F.lit(shards))


def _built(keys: DataFrame, level: int, bits: int, hashes: int, shards: int) -> DataFrame:
    """(shard, words): the words of each shard's filter in order."""
    at = keys.select(_shard(F.col("key"), shards).alias("shard"), F.explode(F.array(*_positions(F.col("key"), F.lit(level), bits, hashes))).alias("p"))
    set_bits = at.groupBy("shard", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x"))
    n = bits // 64
    blank = keys.sparkSession.range(shards * n).select((F.col("id") / n).cast("int").alias("shard"), (F.col("id") % n).alias("w"), F.lit(0).cast("long").alias("x"))
    words = set_bits.union(blank).groupBy("shard", "w").agg(F.bit_or("x").alias("x"))
    return cut(words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("words")))


@dataclass(frozen=True)
class Cascade:
    """Filters in turn for listed keys, for the unlisted that pass, for the listed that pass that, and so on.

    Each level is a table of (shard, words); keys are dealt to shards by hash. With one shard, a level is a scalar
    subquery of one row and nothing is joined. With more, rows meet the few filters of their key's shard by its number:
    no list of keys is joined at any size.
    """

    levels: list[tuple[DataFrame, int]]
    hashes: int
    shards: int

    def _holds(self, i: int, key: Column, words: Column) -> Column:
        held = F.lit(True)
        for p in _positions(key, F.lit(i), self.levels[i][1], self.hashes):
            held = held & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return held

    def with_listed(self, df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
        """df with a column that says whether its key is listed, by the levels from `first` on; exact for every key of the
        universe that the cascade was built from."""
        numbers = range(first, len(self.levels))
        if self.shards == 1:
            words = {i: self.levels[i][0].select("words").scalar() for i in numbers}
        else:
            df = df.withColumn("_shard", _shard(F.col(key), self.shards))
            for i in numbers:
                df = df.join(self.levels[i][0].select(F.col("shard").alias("_shard"), F.col("words").alias(f"_words{i}")), "_shard", "left")
            words = {i: F.col(f"_words{i}") for i in numbers}
        out = F.lit(len(self.levels) % 2 == 1)  # passed them all
        for i in reversed(numbers):
            out = F.when(self._holds(i, F.col(key), words[i]), out).otherwise(F.lit(i % 2 == 1))
        return df.withColumn(name, out).drop("_shard", *[f"_words{i}" for i in numbers])


def cascade(universe: DataFrame, key: str, listed: Column, bits_per_key: int = 10, hashes: int = 5, max_bytes: int = 8 << 20) -> Cascade:
    """A cascade over all distinct non-null keys; `listed` says which are on the list (a key is, if any row says so).

    A shard's filter takes max_bytes at most, by the mean number of keys: there are as many shards as that needs. Levels
    go on until no key is left that passes wrongly; each has its own hashes, so they end.
    """
    keys = universe.select(F.col(key).alias("key"), listed.alias("on")).where("key is not null")
    keys = cut(keys.groupBy("key").agg(F.max(F.coalesce("on", F.lit(False))).alias("on")))
    inside, outside = keys.where("on").select("key"), keys.where(~F.col("on")).select("key")
    shards = max(1, -(-inside.count() * bits_per_key // (8 * max_bytes)))
    levels: list[tuple[DataFrame, int]] = []
    while n := inside.count():
        bits = 64
        while bits < n * bits_per_key / shards:
            bits *= 2
        levels.append((_built(inside, len(levels), bits, hashes, shards), bits))
        # Which keys of the other class pass this level.
        last = Cascade(levels, hashes, shards)
        passed = last.with_listed(outside, "key", "_same", len(levels) - 1).where(F.col("_same") == F.lit(len(levels) % 2 == 1)).select("key")
        inside, outside = cut(passed), inside
    return Cascade(levels, hashes, shards)


def judge(pages: DataFrame, rules: list[Rule], listed: Column, key: str = "page_id", url: str = "url", max_bytes: int = 8 << 20) -> DataFrame:
    """(key, host, path, rule, verdict) for every page.

    The longest rule that fits decides; else the host's membership in the list does: block if listed, allow if not.
    `listed` is a condition over (url, host, path), and a host is on the list if it holds for any of its pages. The
    cascade is built over the complete universe of hosts, so that membership is exact.

    Null urls and urls without :// have the host '' and the path ''. Repeated pages are judged each. An empty table
    gives an empty result. Other columns of `pages` are ignored, whatever their names.
    """
    p = pages.select(F.col(key).alias("k"), F.col(url).alias("url"))
    p = p.select("k", "url", url_host("url").alias("host"), url_path("url").alias("path"))
    p = cascade(p, "host", listed, max_bytes=max_bytes).with_listed(p, "host", "listed")
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = p.select("k", "host", "path", name.alias("rule"), verdict.alias("ruled"), "listed")
    return out.select(
        F.col("k").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
