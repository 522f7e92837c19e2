"""URL filters: exact membership of URL keys in rule lists by cascades of Bloom filters, with no join when URLs are judged.

A cascade has levels of Bloom filters. The first encodes the listed keys. The second encodes those keys of the
corpus that pass the first without being listed, the third the listed keys that pass the second, and so on until
no key is left. Over the corpus's complete key universe the alternation gives exact answers.

The first level's rate of false positives is the listed keys' share of the universe, so about as many keys pass it wrongly as
rightly, and the next levels are of the list's size too, however large the corpus. A level is dealt to shards of SHARD_BITS by
a hash of the key; each shard is made by a task of its own.

A rule is a pair (host, path); it fits its host and every subdomain if the URL's path starts with the rule's path.
The keys of a URL are each suffix of its host at a dot (of no more labels than some rule's host has), joined with each prefix of its path that is as long as some
rule's path. All of it is DataFrame functions; nothing runs in Python.

Cases: a null URL, or one with no ``://``, has an empty host and path, no rule, and the default verdict. Repeated rows
each get their own answer. An empty table gives an empty result; an empty rule list gives the default everywhere.
The longest rule wins; of rules of one length the one with the longer host, and block before allow.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_lower = str.maketrans(UPPER, LOWER)
#: Bits of a level that one task makes.
SHARD_BITS = 1 << 23


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """Array of structs (host, path): host suffixes at dots, of `most` labels or fewer, by the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.size(labels) - most + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(path))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))
    return F.when(host != "", made).otherwise(F.slice(made, 1, 0))


def key_text(key: Column) -> Column:
    """One string for a key: NUL can't stand in a host."""
    return F.concat(key["host"], F.lit("\0"), key["path"])


@dataclass
class Level:
    words: DataFrame  # one row, one column: an array of longs for each shard
    shards: int
    bits: int  # of a shard
    hashes: int


def _shard(key: Column, level: int, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit("shard")), F.lit(shards)).cast("int")


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def bloom(keys: DataFrame, level: int, count: int, rate: float) -> Level:
    """A Bloom filter of column `key`: a grouped OR, and an array of longs for each shard. Its size is that of the keys."""
    hashes = max(1, round(-math.log2(rate)))
    total = count * hashes / math.log(2)
    shards = max(1, math.ceil(total / SHARD_BITS))
    bits = 64 * max(1, math.ceil(total / shards / 64))
    spots = keys.select(_shard(F.col("key"), level, shards).alias("s"), F.explode(F.array(*_positions(F.col("key"), level, hashes, bits))).alias("p"))
    words = spots.select("s", F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")).groupBy("s", "w").agg(F.bit_or("b").alias("b"))
    n = bits // 64
    every = keys.sparkSession.range(0, shards * n, numPartitions=shards).select(F.expr(f"cast(id div {n} as int)").alias("s"), F.expr(f"id % {n}").alias("w"))
    dense = every.join(words, ["s", "w"], "left").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("a"))
    whole = dense.agg(F.array_sort(F.collect_list(F.struct("s", F.col("a.b").alias("words")))).alias("all"))
    return Level(checkpointed(whole.select(F.col("all.words").alias("words"))), shards, bits, hashes)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)
    name: str = "m"

    def attach(self, df: DataFrame) -> DataFrame:
        """df with the levels' words as columns (a scalar subquery each, no join)."""
        return df.withColumns({f"__{self.name}{i}": level.words.scalar() for i, level in enumerate(self.levels)})

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; `attach` comes first. The answer of the first level that the key does not pass."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            level = self.levels[i]
            words = F.element_at(F.col(f"__{self.name}{i}"), _shard(key, i, level.shards) + 1)
            passed = F.lit(True)
            for p in _positions(key, i, level.hashes, level.bits):
                passed = passed & (F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1)
            out = F.when(passed, out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, name: str = "m", rate: float | None = None, later: float = 0.5) -> Cascade:
    """A cascade for column `key` of `listed`, exact over column `key` of `universe` (repeats and nulls allowed).

    rate: false positives of the first level; by default the listed keys' share of the universe.

    Only keys that pass the first level leave the scan of the universe, and repeats meet before the shuffle.
    """
    cascade = Cascade(name=name)
    inside = checkpointed(listed.where(F.col("key").isNotNull()).distinct())
    n = inside.count()
    if not n:
        return cascade
    if rate is None:
        rate = min(0.25, n / max(1, universe.agg(F.approx_count_distinct("key")).first()[0]))
    cascade.levels.append(bloom(inside, 0, n, rate))
    passing = cascade.attach(universe.where(F.col("key").isNotNull())).where(cascade.contains(F.col("key"))).select("key").distinct()
    outside = checkpointed(passing.join(inside, "key", "left_anti"))
    n, other = outside.count(), inside
    while n:
        cascade.levels.append(bloom(outside, len(cascade.levels), n, later))
        wrong = cascade.attach(other).where(cascade.contains(F.col("key")) != F.lit(len(cascade.levels) % 2 == 0)).select("key")
        other, outside = outside, checkpointed(wrong)
        n = outside.count()
    return cascade


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, host, path, rule and verdict for each row. rules: (allow or block, host, path)."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    df = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    most = max([host.count(".") + 1 for _, host, _ in rules], default=1)
    df = df.withColumn("__keys", keys_of(F.col("host"), F.col("path"), lengths, most))
    universe = df.select(F.explode("__keys").alias("k")).select(key_text(F.col("k")).alias("key"))
    found = {}
    for kind in ("allow", "block"):
        rows = [(h.translate(_lower) + "\0" + p,) for v, h, p in rules if v == kind]
        found[kind] = build_cascade(spark.createDataFrame(rows, "key string"), universe, kind)
        df = found[kind].attach(df)
    ranked = F.filter(
        F.transform("__keys", lambda k: F.struct(
            F.length(F.concat(k["host"], k["path"])).alias("size"), F.length(k["host"]).alias("of_host"),
            found["block"].contains(key_text(k)).alias("blocks"), found["allow"].contains(key_text(k)).alias("allows"),
            F.concat(k["host"], k["path"]).alias("rule"),
        )),
        lambda x: x["blocks"] | x["allows"],
    )
    df = df.withColumn("__best", F.array_max(ranked))
    return df.select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.when(F.col("__best").isNull(), default).when(F.col("__best.blocks"), "block").otherwise("allow").alias("verdict"))


#: The rules that the production query judges by.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), RULES, keep=("page_id",))


SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')) t(verdict, rhost, rpath)),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
