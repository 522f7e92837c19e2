"""Scores, tiers, approval and structural votes, as column expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import first_of

# Section kinds that make a structure complete, and those that adorn it.
PRIMARY = ("PALLAVI", "ANUPALLAVI", "CHARANAM", "SAMASHTI_CHARANAM")
TECHNICAL = ("MADHYAMA_KALA", "CHITTASWARAM", "MUKTAYI_SWARA", "ETTUGADA_SWARA", "ETTUGADA_SAHITYA", "SWARA_SAHITYA", "VILOMA_CHITTASWARAM", "SOLKATTU_SWARA", "ANUBANDHA")


def given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def completeness(title: Column, text: Column, owner: Column, mode: Column, metre: Column, sections: Column) -> Column:
    """Four fields count 1, two count a half, over their sum."""
    points = sum((F.when(given(c), 1.0).otherwise(0.0) for c in (title, text, owner, mode)), F.lit(0.0))
    return (points + F.when(given(metre), 0.5).otherwise(0.0) + F.when(F.coalesce(sections, F.lit(False)), 0.5).otherwise(0.0)) / 5.0


def resolution(*levels: Column) -> Column:
    """Mean of the known confidences: HIGH 1, MEDIUM 0.7, other 0.5; 0 with none."""
    worth = [F.when(c == "HIGH", 1.0).when(c == "MEDIUM", 0.7).when(c.isNotNull(), 0.5).otherwise(0.0) for c in levels]
    known = sum((F.when(w > 0, 1).otherwise(0) for w in worth), F.lit(0))
    return F.when(known == 0, 0.0).otherwise(sum(worth, F.lit(0.0)) / known)


def source_quality(source: Column) -> Column:
    return F.when(~given(source), 0.0).when(F.lower(source).contains("blogspot.com"), 0.8).otherwise(0.6)


def validation(source: Column) -> Column:
    return 0.5 + F.when(F.coalesce(source.rlike("(?i)^https?://"), F.lit(False)), 0.5).otherwise(0.0)


def overall(complete: Column, resolved: Column, source: Column, valid: Column) -> Column:
    return complete * 0.40 + resolved * 0.30 + source * 0.20 + valid * 0.10


def tier(score: Column) -> Column:
    return F.when(score >= 0.90, "EXCELLENT").when(score >= 0.75, "GOOD").when(score >= 0.60, "FAIR").otherwise("POOR")


def approved(status: Column, tier_: Column, score: Column, title: Column, text: Column, owners: Column, modes: Column, duplicates: Column, tiers: tuple[str, ...] = ("EXCELLENT", "GOOD"), least: float = 0.75) -> Column:
    """Pending, of an accepted tier and score (unknown ones pass), with title and text, a HIGH owner and a HIGH mode
    among the candidates, and no HIGH duplicate. owners, modes and duplicates are arrays of confidences."""
    some = lambda c: F.coalesce(F.exists(c, lambda x: x == "HIGH"), F.lit(False))
    fair = tier_.isNull() | F.upper(tier_).isin(*tiers)
    return F.coalesce((status == "PENDING") & fair & (score.isNull() | (score >= least)) & given(title) & given(text) & some(owners) & some(modes) & ~some(duplicates), F.lit(False))


def structure_score(types: Column, authority: Column, primary: tuple = PRIMARY, technical: tuple = TECHNICAL) -> Column:
    n = lambda names: F.size(F.filter(types, lambda x: x.isin(*names)))
    return n(primary) * 2.0 + n(technical) * 0.5 + F.size(types) * 0.1 + F.when(authority, 0.5).otherwise(0.0)


def vote(proposals: DataFrame, primary: tuple = PRIMARY, technical: tuple = TECHNICAL) -> DataFrame:
    """work, consensus (types), agreeing, sources, consensus_type and confidence, for works with two proposals or more.

    proposals: work, source, tier, types (array). The best structure wins by score, size, authority, then source.
    """
    p = proposals.withColumn("authority", F.col("tier") <= 2).withColumn("points", structure_score(F.col("types"), F.col("authority"), primary, technical))
    best = first_of(p.where(F.size("types") > 0), ["work"], [F.col("points").desc(), F.size("types").desc(), F.col("authority").desc(), F.col("source")]).select("work", F.col("types").alias("consensus"))
    held = p.join(best, "work").groupBy("work").agg(F.first("consensus").alias("consensus"), F.count_if(F.col("types") == F.col("consensus")).alias("agreeing"), F.count("*").alias("sources"), F.max("authority").alias("by_authority"))
    same = F.col("agreeing") == F.col("sources")
    held = held.where("sources >= 2").withColumn("consensus_type", F.when(same, "UNANIMOUS").when(F.col("by_authority"), "AUTHORITY_OVERRIDE").otherwise("MAJORITY"))
    return held.withColumn("confidence", F.when(same, "HIGH").when(F.col("agreeing") > F.expr("sources div 2"), "MEDIUM").otherwise("LOW")).drop("by_authority")


def overridden(votes: DataFrame, overrides: DataFrame) -> DataFrame:
    """The votes, and for each override (work, structure, reviewer) of a vote one row more: its structure by hand, held for certain."""
    made = votes.join(overrides, "work").withColumn("consensus", F.col("structure")).withColumn("consensus_type", F.lit("MANUAL")).withColumn("confidence", F.lit("HIGH")).drop("structure")
    return votes.withColumn("reviewer", F.lit(None).cast("string")).unionByName(made)
