"""The survey's remaining queries: linkage of imports, variants, votes, work lists and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..operators import layout, linkage, scoring
from ..operators import tables as ops
from ..sources import readers
from .base import Tables, query
from .curation import TASKS, tasks
from .texts import KNOWN, NAMES, RATIO


def known_names(t: Tables) -> DataFrame:
    return t.part.where("p_type = 'ECONOMY' and p_size < 20").select(F.col("p_name").alias("name"))


@query(f"WITH {NAMES}, {KNOWN}, s AS (SELECT n.name, k.name AS candidate, {RATIO.format(a='n.name', b='k.name')} AS score FROM n, k) SELECT name, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS i FROM s WHERE score > 50) WHERE i <= 5")
def join_fuzzy_all(t: Tables) -> DataFrame:
    return linkage.fuzzy(t.part.select(F.col("p_name").alias("name")), known_names(t), 50, 5)


PLAIN, CLOSE = RATIO.format(a="a.title", b="b.title"), RATIO.format(a="replace(lower(a.title), ' ', '')", b="replace(lower(b.title), ' ', '')")


@query(f"WITH x AS (SELECT DISTINCT p_name AS title, p_type AS owner FROM part), p AS (SELECT a.title AS a, a.owner AS owner_a, b.title AS b, b.owner AS owner_b, greatest({PLAIN}, {CLOSE}) AS score FROM x a JOIN x b ON a.title < b.title OR (a.title = b.title AND a.owner < b.owner)) SELECT *, CASE WHEN score > 90 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM p WHERE score >= CASE WHEN owner_a IS NOT DISTINCT FROM owner_b THEN 75 ELSE 85 END")
def dup_detect(t: Tables) -> DataFrame:
    return linkage.detect_duplicates(t.part.select(F.col("p_name").alias("title"), F.col("p_type").alias("owner")))


@query(f"WITH {NAMES}, {KNOWN}, s AS (SELECT n.name, k.name AS id, {RATIO.format(a='n.name', b='k.name')} AS score, left(n.name, 3) = left(k.name, 3) AS same_owner FROM n, k) SELECT name, id, score, same_owner FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS i FROM s WHERE score > CASE WHEN same_owner THEN 75 ELSE 90 END) WHERE i = 1")
def match_import(t: Tables) -> DataFrame:
    pairs = linkage.fuzzy(t.part.select(F.col("p_name").alias("name")), known_names(t), 75)
    pairs = pairs.withColumn("same_owner", F.substring("name", 1, 3) == F.substring("candidate", 1, 3)).withColumnRenamed("candidate", "id")
    return linkage.import_match(pairs, "name")


@query("WITH m AS (SELECT p.p_partkey AS extraction, w.p_partkey AS work FROM part p JOIN (SELECT min(p_partkey) AS p_partkey, p_name FROM part WHERE p_type <> 'SMALL' GROUP BY p_name) w USING (p_name) WHERE p.p_type = 'SMALL') SELECT extraction, work FROM m")
def variant_scope(t: Tables) -> DataFrame:
    """For each primary extraction the first work of its title; a title's first work is found once, before the join."""
    works = t.part.where("p_type <> 'SMALL'").groupBy("p_name").agg(F.min("p_partkey").alias("work"))
    return t.part.where("p_type = 'SMALL'").join(works, "p_name").select(F.col("p_partkey").alias("extraction"), "work")


@query("SELECT conv_id, count(*) AS variants, CAST(sum(n) AS BIGINT) AS sections FROM (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role <> 'assistant' AND trim(text) <> '' GROUP BY 1, 2) GROUP BY 1")
def variants_drop_empty(t: Tables) -> DataFrame:
    """Roles as variants, the assistant's sections being blank; blank sections go, and variants that have no others."""
    text = F.when(F.col("role") == "assistant", " ").otherwise(F.col("text"))
    each = t.conversations.groupBy("conv_id", F.col("role").alias("language")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("sectionOrder"), text.alias("text")))).alias("sections"))
    made = each.groupBy("conv_id").agg(F.collect_list(F.struct("language", F.lit("latin").alias("script"), "sections")).alias("variants"))
    kept = layout.sound_variants(made).where(F.size("variants") > 0)
    sections = F.aggregate("variants", F.lit(0), lambda n, v: n + F.size(v["sections"]))
    return kept.select("conv_id", F.size("variants").cast("long").alias("variants"), sections.cast("long").alias("sections"))


@query("SELECT conv_id, list(upper(role) ORDER BY turn) AS kinds FROM conversations WHERE trim(text) <> '' AND trim(role) <> '' GROUP BY 1")
def json_sanitize(t: Tables) -> DataFrame:
    """Sections of scraped payloads without those that lack a kind or a text."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    df = t.conversations.groupBy("conv_id").agg(rows.alias("rows"))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kinds = F.transform(F.filter("rows", lambda r: filled(r["role"]) & filled(r["text"])), lambda r: F.upper(r["role"]))
    return df.select("conv_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


PICK = "p AS (SELECT l_orderkey AS work, l_suppkey AS source, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS types, min(1 + s_nationkey % 5) <= 2 AS authority FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), s AS (SELECT *, 2.0 * len(list_filter(types, lambda x: x IN ('A', 'N'))) + 0.5 * len(list_filter(types, lambda x: x = 'R')) + 0.1 * len(types) + CASE WHEN authority THEN 0.5 ELSE 0.0 END AS points FROM p)"


@query(f"WITH {PICK} SELECT work, source, round(points, 6)::DOUBLE AS points FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY round(points, 6) DESC, len(types) DESC, authority DESC, source) AS i FROM s) WHERE i = 1")
def vote_pick(t: Tables) -> DataFrame:
    """The best structure of a work: by score, then size, authority and source."""
    df = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    df = df.groupBy(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("source")).agg(types.alias("types"), (F.min(F.lit(1) + F.col("s_nationkey") % 5) <= 2).alias("authority"))
    df = df.withColumn("points", F.round(scoring.structure_score(F.col("types"), F.col("authority"), ("A", "N"), ("R",)), 6))
    return ops.first_of(df, ["work"], [F.col("points").desc(), F.size("types").desc(), F.col("authority").desc(), F.col("source")]).select("work", "source", "points")


@query("WITH d AS (SELECT source, lang, text, CASE WHEN regexp_matches(text, ' {2,}|[ \\t]\\n') THEN 1 ELSE 0 END AS dirty, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents) SELECT source, CAST(sum(dirty) AS BIGINT) AS cleanup, count(*) FILTER (WHERE lang IS NULL) AS gaps, count(*) FILTER (WHERE n > 1) AS duplicates FROM d GROUP BY 1")
def q_remediation(t: Tables) -> DataFrame:
    """What is to be done for each source: texts to clean, fields to fill, copies to drop."""
    dirty = F.coalesce(F.col("text").rlike(r" {2,}|[ \t]\n"), F.lit(False)).cast("int")
    each = t.documents.groupBy("source", F.md5("text").alias("content")).agg(F.sum(dirty).alias("cleanup"), F.count_if(F.col("lang").isNull()).alias("gaps"), (F.count("*") - 1).alias("more"))
    return each.groupBy("source").agg(F.sum("cleanup").alias("cleanup"), F.sum("gaps").alias("gaps"), F.sum("more").alias("duplicates"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE value / 100 >= 0.9) AS excellent, count(*) FILTER (WHERE value / 100 >= 0.75 AND value / 100 < 0.9) AS good, count(*) FILTER (WHERE value / 100 >= 0.6 AND value / 100 < 0.75) AS fair, count(*) FILTER (WHERE value / 100 < 0.6) AS poor FROM events GROUP BY 1")
def q_batch_finalize(t: Tables) -> DataFrame:
    """Status counts, the mean score and how many scores are in each tier."""
    tier = scoring.tier(F.col("value") / 100)
    tiers = [F.count_if((tier == n.upper()) & F.col("value").isNotNull()).alias(n) for n in ("excellent", "good", "fair", "poor")]
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("value"), 6).alias("mean_value"), *tiers)


@query("WITH m AS (SELECT p_name AS unresolved, min(p_brand) AS suggested FROM part WHERE p_size < 10 GROUP BY 1) SELECT p_partkey, coalesce(suggested, p_brand) AS brand, suggested IS NOT NULL AS filled FROM part LEFT JOIN m ON p_name = unresolved")
def q_backfill_alias(t: Tables) -> DataFrame:
    """A resolution map (only its sure rows, one a name) replaces what was not resolved."""
    sure = t.part.where("p_size < 10").groupBy(F.col("p_name").alias("unresolved")).agg(F.min("p_brand").alias("suggested"))
    df = t.part.join(sure, F.col("p_name") == F.col("unresolved"), "left")
    return df.select("p_partkey", F.coalesce("suggested", "p_brand").alias("brand"), F.col("suggested").isNotNull().alias("filled"))


@query("SELECT lang, list_sort(list(DISTINCT source)) AS tags FROM documents WHERE source IS NOT NULL GROUP BY 1")
def q_tags(t: Tables) -> DataFrame:
    return t.documents.where("source is not null").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("tags"))


@query("SELECT DISTINCT left(sha256(trim(url)), 16) AS task, 'PENDING' AS status, 0 AS attempts FROM pages WHERE regexp_matches(trim(url), '^https?://[^/?#]+')")
def qs_manifest_stage(t: Tables) -> DataFrame:
    """A task for each address of a manifest; one that is listed twice, or was staged before, gives no second."""
    rows = readers.clean_manifest(t.pages.select(F.concat_ws(" ", F.lit("Page"), "page_id").alias("krithi"), F.col("url").alias("hyperlink")))
    made = rows.select(readers.artefact_key(F.col("hyperlink")).alias("task"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"))
    return ops.insert_ignore(made, made.limit(0), ["task"])


@query(f"WITH {TASKS}, b AS (SELECT id, job, row_number() OVER (PARTITION BY job ORDER BY created_at, id) AS n FROM task WHERE status = 'DONE') SELECT id, job, c_mktsegment AS owner, CASE WHEN c_custkey IS NULL THEN 'PENDING' ELSE 'MATCHED' END AS outcome FROM b LEFT JOIN customer ON c_custkey = job WHERE n = 1")
def qs_pipeline(t: Tables) -> DataFrame:
    """Done rows, the first of each job, matched with what is known or left pending."""
    done = ops.first_of(tasks(t).where("status = 'DONE'"), ["job"], [F.col("created_at"), F.col("id")])
    df = done.join(t.customer, F.col("c_custkey") == F.col("job"), "left")
    return df.select("id", "job", F.col("c_mktsegment").alias("owner"), F.when(F.col("c_custkey").isNull(), "PENDING").otherwise("MATCHED").alias("outcome"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'first' WHEN contains(lower(url), 'example') THEN 'second' END AS owner FROM pages")
def fn_infer_composer_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", matching.composer_of_address(F.col("url"), {"example.com": "first", "example": "second"}).alias("owner"))
