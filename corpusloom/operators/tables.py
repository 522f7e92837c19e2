"""Operators on tables: lookups, pages, ordered groups, and the change sets that stand for writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the values that are given; None skips a filter."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def where_in(df: DataFrame, column: str, values: list, known: list) -> DataFrame:
    """Rows whose value is listed. Unknown values are dropped from the list; if none is left, the filter is skipped."""
    some = [v for v in values if v in known]
    return df.where(F.col(column).isin(some)) if some else df


def page(df: DataFrame, order: list[Column], number: int = 0, size: int = 20) -> DataFrame:
    """One page in a total order, with the number of rows of all pages in column total."""
    size, number = max(1, min(200, size)), max(0, number)
    total = df.select(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(number * size).limit(size).withColumn("total", total.scalar())


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def renumbered(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose number is not their place within the key (from 1), with that place in new_<column>."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(f"new_{column}", place).where(F.col(f"new_{column}") != F.col(column))


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """How often the keys' combination has come up so far."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def joined_list(value: Column, order: Column, between: str) -> Column:
    """Aggregate: strings in an order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), between)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, by column name."""
    return old.unionByName(new)


def insert_ignore(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key is not there, one for each key (the least row)."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    return first_of(fresh, keys, [F.col(c).asc_nulls_last() for c in fresh.columns if c not in keys] or [F.col(keys[0])])


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert in which nulls of the new row leave the old values."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in rest])
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in rest])
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"__n_{c}", f"__o_{c}").alias(c) for c in rest])


def diff_sync(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What to do to make old into new: op is I, U, D or NOOP, with the values that hold afterwards."""
    o = old.select(*keys, F.struct(*values).alias("__o"), F.lit(True).alias("__in_old"))
    n = new.select(*keys, F.struct(*values).alias("__n"), F.lit(True).alias("__in_new"))
    op = F.when(F.col("__in_old").isNull(), "I").when(F.col("__in_new").isNull(), "D").when(F.col("__o").eqNullSafe(F.col("__n")), "NOOP").otherwise("U")
    made = o.join(n, keys, "full_outer").withColumn("op", op).withColumn("__v", F.coalesce("__n", "__o"))
    return made.select(*keys, "op", *[F.col("__v")[v].alias(v) for v in values])


def find_or_create(mentions: DataFrame, known: DataFrame, key: str, id_: str) -> DataFrame:
    """key, id and created for each distinct mention; ids of new rows are made from the key, so a rerun makes the same."""
    distinct = mentions.select(key).where(F.col(key).isNotNull()).distinct()
    found = distinct.join(known.groupBy(key).agg(F.min(id_).cast("string").alias("id")), key, "left")
    return found.select(key, F.coalesce("id", F.sha2(F.col(key), 256)).alias("id"), F.col("id").isNull().alias("created"))


def missing_pairs(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new without an equal key in old, where null equals null."""
    o = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return new.join(o, on, "left_anti")


def as_of(revisions: DataFrame, keys: list[str], when: str, number: str, at: Column) -> DataFrame:
    """The newest revision of each key that was valid at a time; equal times are settled by the number."""
    rest = [c for c in revisions.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(when, number))
    return revisions.where(F.col(when) <= at).groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def current(revisions: DataFrame, keys: list[str], when: str, number: str) -> DataFrame:
    rest = [c for c in revisions.columns if c not in keys]
    return revisions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, number)).alias("__r")).select(*keys, "__r.*")


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
