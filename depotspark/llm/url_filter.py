"""URL filter: path rules first, then exact membership in a list of blocked domains by a Bloom filter cascade.

The cascade alternates levels: level 0 holds the listed keys, level 1 those keys of the corpus's complete key
universe that level 0 lets through wrongly, level 2 the listed keys that level 1 lets through, and so on until
nothing is left. Over that universe (and over the list) the answer is exact, without any join. The universe is
every distinct domain suffix of the hosts seen. Bits are set by a distributed bit_or over 64-bit words, and
only the filters reach the driver: their size depends on the list and on the logarithm of the universe, and is
checked against `max_bits` before it becomes a literal.

Defined cases: a null url or one without "://" has an empty host and path; an empty host matches no rule and is
no listed key, so it is allowed; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import materialize, table

#: (verdict, host and path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Listed domains; a host is listed if it or a parent domain is on the list.
BLOCKED_DOMAINS = ["ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org"]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null; rules are a short parameter list, so this is one CASE."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _positions(key: Column, bits: int, hashes: int, level: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
    # 31-bit halves keep the products within a long
    a, b = F.pmod(a, F.lit(1 << 31)), F.pmod(b, F.lit(1 << 31))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)]


class Level:
    def __init__(self, bits: int, hashes: int, level: int, words: list[int]):
        self.bits, self.hashes, self.level, self.words = bits, hashes, level, words

    def holds(self, key: Column) -> Column:
        lit = F.array(*[F.lit(w) for w in self.words]) if len(self.words) <= 64 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        out = F.lit(True)
        for p in _positions(key, self.bits, self.hashes, self.level):
            word = F.element_at(lit, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def build_level(keys: DataFrame, n_keys: int, rate: float, level: int, max_bits: int) -> Level:
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n_keys * hashes / math.log(2) / 64) * 64)
    if bits > max_bits:
        raise ValueError(f"level {level} of the cascade needs {bits} bits; the bound is {max_bits}")
    words = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, level))).alias("p"))
    words = words.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).collect()
    full = [0] * (bits // 64)
    for r in words:
        full[r.w] = r.v
    return Level(bits, hashes, level, full)


class Cascade:
    """Exact membership over a universe. listed and universe: DataFrames with a string column `key`."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 24):
        listed = listed.where("key is not null").distinct()
        # the universe's share of the list itself doesn't count as false positive
        others = materialize(universe.where("key is not null").distinct().join(listed, "key", "left_anti"))
        n, rest, n_rest = listed.count(), others, others.count()
        self.levels: list[Level] = []
        current, n_current = listed, n
        while n_current:  # each level has hashes of its own and leaves fewer keys
            rate = 0.5 if self.levels else min(0.5, max(2.0**-30, n_current / max(1, n_rest) / 2))
            one = build_level(current, n_current, rate, len(self.levels), max_bits)
            self.levels.append(one)
            wrong = materialize(rest.where(one.holds(F.col("key"))))
            current, n_current, rest = wrong, wrong.count(), current

    def holds(self, key: Column) -> Column:
        """Walks the levels: leaving at an even level means not listed, at an odd one listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED_DOMAINS, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, listed and verdict to the rows; other columns stay (those of the same names are replaced).

    blocked: domains, as a list or as a table with a column `key`.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    rows = pages.withColumn("host", host).withColumn("path", path)
    universe = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    listed = blocked.select("key") if isinstance(blocked, DataFrame) else spark.createDataFrame([(x,) for x in blocked], "key string")
    cascade = Cascade(listed, universe)
    hit = F.exists(suffixes(F.col("host")), cascade.holds)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    verdicts = F.lit(None).cast("string")
    for v, r in rules:
        verdicts = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdicts)
    return rows.withColumn("rule", rule).withColumn("listed", hit).withColumn("verdict", F.coalesce(verdicts, F.when(F.col("listed"), "block").otherwise("allow")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r as (select *, case
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from q)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when regexp_matches(host, '(^|\\.)(ads-track\\.example\\.org|casino-win\\.example\\.org|cheap-pills\\.example\\.com|free-bets\\.example\\.com|spam-farm\\.example\\.org)$') then 'block' else 'allow' end as verdict
from r
"""
