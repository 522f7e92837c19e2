"""More queries on strings, linkage and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching, scoring_text
from ..functions import text as tx
from ..operators import linkage
from ..operators import tables as ops
from ..streaming import ingest
from .base import Tables, query
from .curation import TASKS, tasks
from .texts import KNOWN, NAMES, RATIO


@query(f"WITH {NAMES} SELECT a.name AS a, b.name AS b, round(1.0::DOUBLE - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON left(a.name, 3) = left(b.name, 3) AND a.name < b.name")
def fn_lev_similarity(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("a")).distinct().withColumn("block", F.substring("a", 1, 3))
    pairs = names.join(names.withColumnRenamed("a", "b"), "block").where("a < b")
    return pairs.select("a", "b", F.round(tx.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def fn_lev_ratio_500(t: Tables) -> DataFrame:
    """Texts of one language and source, neighbours by id, by their starts. Only starts go through the windows, which are few and
    uneven; the pairs are dealt out again before they are compared."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    df = t.documents.select("lang", "source", "doc_id", matching.start_of(F.col("text")).alias("start"))
    df = df.select("doc_id", "start", F.lag("doc_id").over(w).alias("before"), F.lag("start").over(w).alias("other")).where("before is not null")
    return df.repartition("doc_id").select("doc_id", "before", tx.ratio(F.col("start"), F.col("other")).alias("score"))


@query()
def fn_wratio(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name"))
    return linkage.fuzzy(names, names, 60).select("name", "candidate", F.round(matching.sequence_ratio("name", "candidate"), 6).alias("ratio"))


@query(f"WITH {NAMES}, s AS (SELECT a.name, b.name AS candidate, replace(a.name, ' ', '') AS x, replace(b.name, ' ', '') AS y FROM n a, n b WHERE {RATIO.format(a='a.name', b='b.name')} > 60) SELECT name, candidate, CAST(list_max(list_transform(range(1, length(x) + 1), lambda i: list_max(list_filter(range(0, length(x) - i + 2), lambda k: contains(y, substr(x, i, k)))))) AS INTEGER) AS run FROM s")
def fn_longest_shared_run(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name"))
    return linkage.fuzzy(names, names, 60).select("name", "candidate", matching.longest_shared_run("name", "candidate").alias("run"))


@query(f"WITH {NAMES} SELECT a.name AS a, b.name AS b, round(list_sum(list_transform(range(1, least(length(a.name), length(b.name)) + 1), lambda i: CASE WHEN a.name[i] = b.name[i] THEN 1 ELSE 0 END))::DOUBLE / greatest(length(a.name), length(b.name)), 6) AS overlap FROM n a JOIN n b ON left(a.name, 3) = left(b.name, 3) AND a.name < b.name")
def fn_position_overlap(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("a")).distinct().withColumn("block", F.substring("a", 1, 3))
    pairs = names.join(names.withColumnRenamed("a", "b"), "block").where("a < b")
    return pairs.select("a", "b", F.round(tx.position_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("SELECT p_partkey, length(regexp_replace(p_name || ' 1.', '[\\s\\d.–—:-]+', '', 'g')) >= 0.97 * length(regexp_replace(p_name, '[\\s\\d.–—:-]+', '', 'g')) AS kept FROM part")
def fn_content_preserved(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.content_preserved(F.col("p_name"), F.concat("p_name", F.lit(" 1."))).alias("kept"))


@query("SELECT page_id, CASE lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'PDF' WHEN 'csv' THEN 'CSV' WHEN 'json' THEN 'API' ELSE 'HTML' END AS format, CASE WHEN contains(lower(url), 'example.com') THEN 'first' WHEN contains(lower(url), 'example') THEN 'second' END AS owner FROM pages")
def fn_infer_format(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", matching.format_of_address(url).alias("format"), matching.composer_of_address(url, {"example.com": "first", "example": "second"}).alias("owner"))


@query("SELECT doc_id, left(text, CAST(list_max(list_filter(range(0, least(length(text), 1000) + 1), lambda k: strlen(left(text, CAST(k AS BIGINT))) <= 1000)) AS BIGINT)) AS start FROM documents")
def fn_truncate_utf8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", matching.cut_to_bytes(F.col("text"), 1000).alias("start"))


@query("SELECT doc_id, false AS unread FROM documents")
def fn_force_ocr(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", matching.needs_reading_by_eye(F.col("text")).alias("unread"))


@query("SELECT p_partkey, upper(trim(regexp_replace(regexp_replace('(' || p_name || ') | ' || p_type, '[\\[\\](){}]', '', 'g'), '[\\s,;|]+', ' ', 'g'))) AS notation FROM part")
def fn_swara_notation(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", matching.swara_notation(F.concat(F.lit("("), "p_name", F.lit(") | "), "p_type")).alias("notation"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) >= 3 AND NOT regexp_matches(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '^(index|contents|introduction|preface|foreword|glossary|bibliography|appendix)$') AS valid FROM pages")
def fn_valid_segment_title(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", title.alias("title"), scoring_text.valid_title(title).alias("valid"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name FROM part")
def fn_cleanup_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", matching.title_case(tx.repaired(F.trim(F.regexp_replace(F.concat("p_name", F.lit(" (28)")), r"\s*\(\d+\)\s*", "")))).alias("name"))


FIELD = r"nullif(trim(regexp_extract(x, '(?im)^\s*{name}\s*[:–—-]\s*(.+)$', 1)), '')"


@query("SELECT doc_id, " + ", ".join(f"{FIELD.format(name=p)} AS {n}" for n, p in (("raga", "r[aā]ga[mṁ]?"), ("tala", "t[aā][lḷ]a[mṁ]?"), ("composer", "composer"), ("deity", "deity"), ("temple", "temple"))) + " FROM (SELECT doc_id, 'Raga: ' || lang || chr(10) || 'Tala - ' || source || chr(10) || text AS x FROM documents)")
def parse_metadata(t: Tables) -> DataFrame:
    """Head fields of texts that carry them; here the corpus's texts with labels put before them."""
    from ..operators.structure import metadata

    text = F.concat(F.lit("Raga: "), "lang", F.lit("\nTala - "), "source", F.lit("\n"), "text")
    return t.documents.select("doc_id", *[c.alias(n) for n, c in metadata(text).items()])


@query("SELECT p_name AS name, max(p_size) FILTER (WHERE p_type = 'SMALL') AS first_size, coalesce(max(p_size) FILTER (WHERE p_type = 'SMALL'), max(p_size) FILTER (WHERE p_type = 'ECONOMY'), max(p_size)) AS size FROM part GROUP BY 1")
def raga_merge(t: Tables) -> DataFrame:
    """Three sources of one key; a later one fills only what is empty."""
    side = lambda cond, name: t.part.where(cond).groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias(name))
    df = side("p_type = 'SMALL'", "first_size").join(side("p_type = 'ECONOMY'", "second"), "name", "full_outer").join(side("true", "third"), "name", "full_outer")
    return df.select("name", "first_size", F.coalesce("first_size", "second", "third").alias("size"))


@query(f"WITH {NAMES}, {KNOWN}, s AS (SELECT n.name, k.name AS candidate, {RATIO.format(a='n.name', b='k.name')} AS score FROM n, k) SELECT name, list(candidate ORDER BY score DESC, candidate) AS candidates, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS i FROM s WHERE score > 60) WHERE i <= 5 GROUP BY 1")
def er_identity_candidates(t: Tables) -> DataFrame:
    known = t.part.where("p_type = 'ECONOMY' and p_size < 20").select(F.col("p_name").alias("name"))
    found = linkage.fuzzy(t.part.select(F.col("p_name").alias("name")), known, 60, 5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "candidate"))), lambda x: x["candidate"])
    return found.groupBy("name").agg(ordered.alias("candidates"), F.max("score").alias("best"))


@query("SELECT p_brand, p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2, 3")
def match_create_guard(t: Tables) -> DataFrame:
    """A work is made once for each title and owner; the rest reuse it."""
    return t.part.groupBy("p_brand", "p_type", "p_name").agg(F.count("*").alias("n"))


@query("SELECT source, host, count(*) AS n FROM (SELECT d.source, CASE WHEN d.source IN ('src0', 'src1') THEN 'first' WHEN d.source = 'src2' THEN 'second' END AS host FROM documents d) WHERE host IS NOT NULL GROUP BY 1, 2")
def authority_source(t: Tables) -> DataFrame:
    """A fixed lookup of preferred sources, as an expression."""
    host = F.when(F.col("source").isin("src0", "src1"), "first").when(F.col("source") == "src2", "second")
    return t.documents.select("source", host.alias("host")).where("host is not null").groupBy("source", "host").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value, count(*) FILTER (WHERE value >= 50) AS high, count(*) FILTER (WHERE value < 50) AS low FROM events GROUP BY 1")
def q_batch_report(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean_value"), F.count_if(v >= 50).alias("high"), F.count_if(v < 50).alias("low"))


@query("SELECT confidence, count(*) AS n, count(*) FILTER (WHERE anomaly) AS anomalies FROM (SELECT CASE WHEN l_discount >= 0.08 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, l_tax > l_discount AS anomaly FROM lineitem) GROUP BY 1")
def q_variant_report(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    band = F.when(d >= 0.08, "HIGH").when(d >= 0.04, "MEDIUM").otherwise("LOW")
    return t.lineitem.groupBy(band.alias("confidence")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > d).alias("anomalies"))


@query(f"WITH {TASKS} SELECT job, count(*) AS total, sum(attempts) AS attempts, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM task GROUP BY 1".replace("sum(attempts)", "CAST(sum(attempts) AS BIGINT)"))
def qs_counters(t: Tables) -> DataFrame:
    """Counters are derived, never incremented."""
    return tasks(t).groupBy("job").agg(F.count("*").alias("total"), F.sum("attempts").alias("attempts"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query(f"WITH {TASKS} SELECT id, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'CANCELLED' ELSE status END AS status FROM task")
def qs_batch_control(t: Tables) -> DataFrame:
    open_ = F.col("status").isin("PENDING", "RUNNING")
    return tasks(t).select("id", F.when(open_, "CANCELLED").otherwise(F.col("status")).alias("status"))


@query(f"WITH {TASKS} SELECT id, job, 'INGESTED' AS status FROM task WHERE status = 'DONE'")
def qs_cas_ingest(t: Tables) -> DataFrame:
    """Done rows change to ingested; a row in any other state is left alone, so a second run finds none."""
    return tasks(t).where("status = 'DONE'").select("id", "job", F.lit("INGESTED").alias("status"))


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def qs_dispatch(t: Tables) -> DataFrame:
    return ingest.counts_by_minute(t.events)


@query("SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'APPROVE' WHEN l.quality = 0 OR l.toxic = 1 THEN 'REJECT' ELSE 'REVIEW' END AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def qs_resolution_stage(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVE").when((F.col("quality") == 0) | (F.col("toxic") == 1), "REJECT").otherwise("REVIEW")
    return df.select("doc_id", "lang", "quality", decision.alias("decision"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, count(*) OVER (PARTITION BY l_orderkey) AS of_lines FROM lineitem")
def st_blocks(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    df = ops.occurrence(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "place")
    return df.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("of_lines"))


@query("SELECT o_orderkey, CASE WHEN n = 0 THEN 'none' WHEN flags <> lines THEN 'count differs' WHEN n < 2 THEN 'prepend' ELSE 'skip' END AS plan FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(l_returnflag) AS flags, count(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def section_repair_plan(t: Tables) -> DataFrame:
    """Which works a repair would touch, and how; gates come before any change."""
    each = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count("l_returnflag").alias("flags"), F.count("l_linenumber").alias("lines"))
    df = t.orders.join(each, "o_orderkey", "left").na.fill(0, ["n", "flags", "lines"])
    plan = F.when(F.col("n") == 0, "none").when(F.col("flags") != F.col("lines"), "count differs").when(F.col("n") < 2, "prepend").otherwise("skip")
    return df.select("o_orderkey", plan.alias("plan"))


def conversation_sections(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("section_no"), F.upper("role").alias("kind"), "text")


@query("WITH p AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role <> 'assistant' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)) SELECT conv_id AS doc_id, CAST(parent AS INTEGER) AS section_no, upper(arg_min(role, turn)) AS kind, string_agg(text, chr(10) ORDER BY turn) AS text FROM p GROUP BY conv_id, parent")
def st_demote_mks(t: Tables) -> DataFrame:
    """An assistant's turn becomes the end of the turn before it."""
    from ..operators.layout import demoted

    return demoted(conversation_sections(t), "ASSISTANT")


@query()
def st_merge_dual(t: Tables) -> DataFrame:
    from ..operators.layout import merged_twins

    return merged_twins(conversation_sections(t))


@query("SELECT doc_id, 'raga' AS label, CAST(length(text) + 1 AS INTEGER) AS start, CAST(length(text) + 7 + length(lang) AS INTEGER) AS \"end\" FROM documents")
def st_boundaries(t: Tables) -> DataFrame:
    from ..operators.layout import boundaries

    return boundaries(t.documents.select("doc_id", F.concat("text", F.lit("\nRaga: "), "lang").alias("text")))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_no, lang AS raga, false AS backward FROM documents")
def st_ragamalika(t: Tables) -> DataFrame:
    from ..operators.layout import raga_markers

    return raga_markers(t.documents.select("doc_id", F.concat("text", F.lit("\n"), "lang", F.lit(" ragam")).alias("text")))


@query()
def segment_pages(t: Tables) -> DataFrame:
    """Lines of texts as blocks: a text's first line of each ten is set large and bold."""
    from ..operators.layout import segments

    parts = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    large = F.col("i") % 10 == 0
    return segments(parts.select("doc_id", F.floor(F.col("i") / 10).cast("int").alias("page"), (F.col("i") % 10).cast("double").alias("y0"), F.when(large, 14.0).otherwise(10.0).alias("font_size"), large.alias("is_bold"), "text"))
