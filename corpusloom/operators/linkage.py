"""Record linkage: blocking on equal keys, then edit distance within blocks, then ranking.

No step compares everything with everything: distinct names meet by equi-joins on signatures of their parts, lengths and
characters prune the pairs within the join, the edit distance is bounded by the threshold, and the exact matches leave first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .tables import first_of


def confidence(score: Column) -> Column:
    return F.when(score >= 90, "HIGH").when(score >= 70, "MEDIUM").otherwise("LOW")


def compressed(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


#: Letters from rare to frequent, for block keys; any order is right, this one makes small blocks.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


def block_keys(c: Column, least: int) -> Column:
    """Keys of which two strings with a ratio over `least` share one.

    Such strings have over least/100 of the longer one's characters in common (counted with repeats), so with each
    string's numbered characters in one fixed order, the first n - k + 1 of n meet, k being the fewest to be shared.
    """
    n = F.length(c)

    def numbered(i: Column) -> Column:
        ch, upto = F.substring(c, i, F.lit(1)), F.substring(c, F.lit(1), i)
        return F.struct(F.position(ch, F.lit(RARE_FIRST)).alias("rank"), ch.alias("ch"), (F.length(upto) - F.length(F.replace(upto, ch, F.lit("")))).alias("no"))

    ordered = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), numbered))
    return F.slice(ordered, F.lit(1), F.greatest(n - F.floor(n * least / 100).cast("int"), F.lit(1)))


def allowed(longer: Column, least: int) -> Column:
    """The most edits that leave a ratio over `least`, the longer string having so many characters."""
    return F.floor(longer * (99 - least) / 100).cast("int")


def part_of(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part i of edits + 1 parts, the longer ones last."""
    size = F.floor(length / (edits + 1)).cast("int")
    short = edits + 1 - length % (edits + 1)  # parts of that size; the others have one more
    return i * size + F.greatest(i - short, F.lit(0)), size + (i >= short).cast("int")


def parts(c: Column, least: int) -> Column:
    """Keys of a string's parts: one more than it may have edits, so one part is left whole by them."""
    n, edits = F.length(c), allowed(F.length(c), least)

    def key(i: Column) -> Column:
        at, size = part_of(n, edits, i)
        return F.xxhash64(n, i, F.substring(c, at + 1, size))

    return F.transform(F.sequence(F.lit(0), edits), key)


def probes(c: Column, least: int, most: int) -> Column:
    """Keys of the places where a string can have a part of another one of its length or longer (`most` at most).

    Part i has at most i edits before it and edits - i behind it, which bounds how far it can have moved from either end.
    """
    n = F.length(c)

    def of_length(other: Column) -> Column:
        edits = allowed(other, least)

        def of_part(i: Column) -> Column:
            at, size = part_of(other, edits, i)
            low = F.greatest(at - i, at + n - other - (edits - i), F.lit(0))
            high = F.least(at + i, at + n - other + (edits - i), n - size)
            keys = F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.xxhash64(other, i, F.substring(c, p + 1, size)))
            return F.when(low <= high, keys).otherwise(F.slice(keys, 1, 0))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_part))

    last = F.least(F.floor(n * 100 / (least + 1)).cast("int"), F.lit(most))
    lengths = F.sequence(n, F.greatest(n, last))
    return F.array_distinct(F.flatten(F.transform(F.when(n <= most, lengths).otherwise(F.slice(lengths, 1, 0)), of_length)))


#: Probes of one string; longer strings (over 15 characters at a threshold of 50, 37 at 75, 110 at 90) use block_keys().
PROBES = 400


def longest_probed(least: int, most: int = PROBES) -> int:
    """The greatest length whose strings have at most so many probes."""
    n = 0
    while n < 4096:
        edits = lambda m: m * (99 - least) // 100
        if sum((edits(m) ** 2 - (m - n) ** 2) // 2 + edits(m) + 1 for m in range(n + 1, (n + 1) * 100 // (least + 1) + 1)) > most:
            break
        n += 1
    return n


def character_bits(c: Column) -> Column:
    """A bit for every numbered character ("second a"), of 64 by hash: an edit changes at most two."""
    n = F.length(c)

    def bit(i: Column) -> Column:
        ch, upto = F.substring(c, i, F.lit(1)), F.substring(c, F.lit(1), i)
        number = F.length(upto) - F.length(F.replace(upto, ch, F.lit("")))
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(ch, number), F.lit(64)).cast("int"))

    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), bit)).otherwise(F.array(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


#: Rows of a key on one side from which they are dealt to several tasks.
HEAVY = 5000


def join_split(left: DataFrame, right: DataFrame, on: Column, heavy: int = HEAVY) -> DataFrame:
    """Inner join of left and right on key (both have it) and `on`; the rows that a key has on the left are dealt out by hash, so
    that no task meets more than about `heavy` of them with those of the right."""
    crowded = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("key", F.ceil(F.col("n") / heavy).cast("int").alias("shares"))
    dealt = left.join(crowded, "key", "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("name"), F.col("shares"))).cast("int")).drop("shares")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1)
    copied = right.join(crowded, "key", "left").withColumn("share", F.explode(copies)).drop("shares")
    return dealt.join(copied, ["key", "share"]).where(on).drop("key", "share")


def candidates(left: DataFrame, right: DataFrame, least: int, heavy: int = HEAVY) -> DataFrame:
    """Pairs (name, candidate) that parts, lengths and characters don't deny a ratio over `least`; none of such a ratio is lost. A pair may repeat.

    The longer string of a pair is cut into parts, one of which the shorter one has whole and near its place. Strings too long for that
    share a rare character within a band of lengths.
    """
    most, side = longest_probed(least), ("name", "candidate")
    marked = [df.select(c, character_bits(F.col(c)).alias(f"bits_{c}")) for df, c in zip((left, right), side, strict=True)]
    keys = [(parts(F.when(F.length(c) <= most, F.col(c)), least), probes(F.col(c), least, most)) for c in side]
    empty = F.array().cast("array<bigint>")
    mirrored = lambda k: F.transform(F.coalesce(k, empty), lambda x: F.bitwise_not(x))
    one = marked[0].withColumn("key", F.explode(F.concat(F.coalesce(keys[0][0], empty), mirrored(keys[0][1]))))
    other = marked[1].withColumn("key", F.explode(F.concat(keys[1][1], mirrored(keys[1][0]))))
    longer, shorter = F.greatest(F.length("name"), F.length("candidate")), F.least(F.length("name"), F.length("candidate"))
    edits = allowed(longer, least)
    close = (longer - shorter <= edits) & (F.bit_count(F.col("bits_name").bitwiseXOR(F.col("bits_candidate"))) <= 2 * edits)
    near = join_split(one, other, close, heavy)
    # lengths of one pair differ by less than 100 / least, which is one band, so one side goes to its band's neighbours as well
    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / math.log(100 / max(least, 1))).cast("int")
    rare = [df.where(F.length(c) >= (most + 1) * (least + 1) // 100).withColumn("band", band(F.col(c))).withColumn("k", F.explode(block_keys(F.col(c), least))) for df, c in zip(marked, side, strict=True)]
    rare[1] = rare[1].withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    rare = [df.withColumn("key", F.xxhash64("k", "band")).drop("k", "band") for df in rare]
    far = join_split(*rare, close & (longer > most), heavy)
    return near.select(*side).unionByName(far.select(*side))


def fuzzy(names: DataFrame, known: DataFrame, least: int, top: int | None = None) -> DataFrame:
    """(name, candidate, score) of distinct names and known names with a ratio over `least`; none is lost to blocking.

    Pairs that several parts bring together meet before the edit distance is taken, which goes no further than the threshold allows.
    """
    left = names.select(F.col("name")).where("name is not null").distinct()
    right = known.select(F.col("name").alias("candidate")).where("candidate is not null").distinct()
    longer = F.greatest(F.length("name"), F.length("candidate"))
    edits = F.call_function("levenshtein", F.col("name"), F.col("candidate"), allowed(longer, least))
    score = F.when(longer == 0, 100).otherwise(((F.lit(1.0) - F.col("edits").cast("double") / longer) * 100).cast("int"))
    scored = candidates(left, right, least).distinct().withColumn("edits", edits).where("edits >= 0").withColumn("score", score).where(F.col("score") > least)
    scored = scored.select("name", "candidate", "score")
    return first_of(scored, ["name"], [F.col("score").desc(), F.col("candidate")], top) if top else scored


def resolve(mentions: DataFrame, known: DataFrame, least: int = 50, top: int = 5) -> DataFrame:
    """(name, candidate, score, confidence): exact names first (100), then the best fuzzy ones."""
    distinct = mentions.select("name").where("name is not null").distinct()
    ref = known.select("name").where("name is not null").distinct()
    exact = distinct.join(ref, "name", "left_semi").select("name", F.col("name").alias("candidate"), F.lit(100).alias("score"))
    rest = fuzzy(distinct.join(ref, "name", "left_anti"), ref, least, top)
    return exact.unionByName(rest).withColumn("confidence", confidence(F.col("score")))


def duplicates_by_prefix(titles: DataFrame, width: int = 12, at_least: int = 5, agreeing: int = 75, else_: int = 85) -> DataFrame:
    """(a, owner_a, b, owner_b, score, same_owner) of rows (title, owner) whose compressed titles begin alike; owners that agree lower the bar.

    Equal titles meet once. Pairs come from fuzzy(), so a common beginning costs nothing.
    """
    t = titles.select(compressed(F.col("title")).alias("key"), "owner").where(F.length("key") >= at_least).distinct()
    names = t.select(F.col("key").alias("name"))
    close = fuzzy(names, names, agreeing - 1).where(F.substring("name", 1, width) == F.substring("candidate", 1, width)).where("name <= candidate")
    pairs = close.toDF("a", "b", "score").join(t.toDF("a", "owner_a"), "a").join(t.toDF("b", "owner_b"), "b")
    pairs = pairs.where((F.col("a") < F.col("b")) | (F.col("owner_a") < F.col("owner_b"))).withColumn("same_owner", F.col("owner_a").eqNullSafe(F.col("owner_b")))
    return pairs.where(F.col("score") >= F.when(F.col("same_owner"), agreeing).otherwise(else_)).select("a", "owner_a", "b", "owner_b", "score", "same_owner")


def best_match(pairs: DataFrame, key: str, strict_compat: bool = False, floors: tuple[int, int] = (88, 92)) -> DataFrame:
    """The best of scored pairs (key, id, score, same_owner): over floors[0] with the owner, else over floors[1]; within 5 of the best, the
    owner decides, then the score, then the id. strict_compat turns the choice within the shortlist around."""
    ok = pairs.where(F.col("score") > F.when(F.col("same_owner"), floors[0]).otherwise(floors[1]))
    top = ok.groupBy(key).agg((F.max("score") - 5).alias("__least"))
    short = ok.join(top, key).where(F.col("score") >= F.col("__least")).drop("__least")
    order = [F.col("same_owner").asc(), F.col("score").asc()] if strict_compat else [F.col("same_owner").desc(), F.col("score").desc()]
    return first_of(short, [key], [*order, F.col("id")])


def variant_score(title: Column, first: Column, second: Column, position: Column) -> Column:
    """0.5 title, 0.3 the mean of two attributes, 0.2 position."""
    return 0.5 * title + 0.3 * (first + second) / 2.0 + 0.2 * position


def variant_band(score: Column, high: float = 0.75, medium: float = 0.5) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def detect_duplicates(titles: DataFrame, agreeing: int = 75, else_: int = 85, high: int = 90) -> DataFrame:
    """(a, owner_a, b, owner_b, score, confidence) of rows (title, owner) whose titles are alike, as written or without blanks.

    The better of both scores counts; owners that agree (two unknown ones do) lower the bar. Equal titles meet once.
    """
    rows = titles.select("title", "owner").where("title is not null").distinct()
    names = rows.select("title", compressed(F.col("title")).alias("key")).distinct()
    plain = fuzzy(names.select(F.col("title").alias("name")), names.select(F.col("title").alias("name")), agreeing - 1).select("name", "candidate")
    close = fuzzy(names.select(F.col("key").alias("name")), names.select(F.col("key").alias("name")), agreeing - 1).select("name", "candidate")
    back = lambda old, new: names.select(F.col("key").alias(old), F.col("title").alias(new))
    close = close.join(back("name", "a"), "name").join(back("candidate", "b"), "candidate").select("a", "b")
    pairs = plain.toDF("a", "b").unionByName(close).where("a <= b").distinct()
    score = F.greatest(tx.ratio(F.col("a"), F.col("b")), tx.ratio(compressed(F.col("a")), compressed(F.col("b"))))
    pairs = pairs.withColumn("score", score).join(rows.toDF("a", "owner_a"), "a").join(rows.toDF("b", "owner_b"), "b")
    pairs = pairs.where(F.struct("a", F.col("owner_a").alias("o")) < F.struct(F.col("b").alias("a"), F.col("owner_b").alias("o")))  # null before all
    bar = F.when(F.col("owner_a").eqNullSafe(F.col("owner_b")), agreeing).otherwise(else_)
    return pairs.where(F.col("score") >= bar).withColumn("confidence", F.when(F.col("score") > high, "HIGH").otherwise("MEDIUM"))


def import_match(pairs: DataFrame, key: str, floors: tuple[int, int] = (75, 90)) -> DataFrame:
    """The best of scored pairs (key, id, score, same_owner): over floors[0] with the owner, else over floors[1]; the highest
    score wins, then the id."""
    ok = pairs.where(F.col("score") > F.when(F.col("same_owner"), floors[0]).otherwise(floors[1]))
    return first_of(ok, [key], [F.col("score").desc(), F.col("id")])
