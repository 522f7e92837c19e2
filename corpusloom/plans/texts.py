"""Functions on names and texts, record linkage, HTML and structure, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import linkage, structure
from ..operators import tables as ops
from ..sources import html, readers
from .base import Tables, query

# --- sources


@query("SELECT 'Page ' || page_id AS krithi, CASE WHEN trim(regexp_extract(url, '/([a-z]+)/', 1)) = '' THEN NULL ELSE regexp_extract(url, '/([a-z]+)/', 1) END AS raga, trim(url) AS hyperlink FROM pages WHERE regexp_matches(trim(url), '^https?://[^/?#]+')")
def src_csv_manifest(t: Tables) -> DataFrame:
    rows = t.pages.select(F.concat_ws(" ", F.lit("Page"), "page_id").alias(" Krithi"), F.regexp_extract("url", "/([a-z]+)/", 1).alias("RAGA"), F.col("url").alias("Hyperlink "))
    return readers.clean_manifest(rows)


@query("SELECT page_id, left(sha256(url), 16) AS artefact, length(html) AS chars FROM pages")
def src_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", readers.artefact_key(F.col("url")).alias("artefact"), F.length("html").cast("long").alias("chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def src_json_payload(t: Tables) -> DataFrame:
    df = readers.payloads(t.events.withColumn("payload", F.concat(F.lit("["), "props", F.lit("]"))), schema="struct<k: int>")
    return df.select("event_id", F.col("extraction.k").alias("k")).where("k is not null")


@query()
def html_extract(t: Tables) -> DataFrame:
    return html.extract_pages(t.pages)


# --- functions on strings


@query("SELECT doc_id, translate(text, 'āĀīĪūŪēĒōŌṭṬḍḌṇṆṅṄñÑśŚṣṢṃṂḥḤṛṚṝṜḷḶ', 'aAiIuUeEoOtTdDnNnNnNsSsSmMhHrRrRlL') AS plain FROM documents")
def fn_strip_diacritics_sql(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_diacritics(F.col("text")).alias("plain"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents WHERE NOT regexp_matches(text, '[ßøłđ]')")
def fn_nfd_strip_mn(t: Tables) -> DataFrame:
    return t.documents.where(~F.col("text").rlike("[ßøłđ]")).select("doc_id", tx.without_marks(F.col("text")).alias("plain"))


BASIC = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\b(saint|sri|swami|sir|dr|prof|smt)\b', '', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, {BASIC.format(c='c_name')} AS key FROM customer")
def fn_basic_normalize(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.basic_key(F.col("c_name")).alias("key"))


@query(f"SELECT s_suppkey, CASE WHEN contains(k, 'diksitar') OR contains(k, 'dikshitar') THEN 'muttuswami diksitar' ELSE k END AS key FROM (SELECT s_suppkey, {BASIC.format(c='s_name')} AS k FROM supplier)")
def fn_norm_composer(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", tx.composer_key(F.col("s_name")).alias("key"))


@query(f"SELECT p_partkey, replace(replace(replace(replace(replace({BASIC.format(c='p_name')}, 'aa', 'a'), 'ee', 'i'), 'oo', 'o'), 'uu', 'u'), ' ', '') AS key FROM part")
def fn_norm_raga(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.raga_key(F.col("p_name")).alias("key"))


@query(f"SELECT p_partkey, CASE WHEN ends_with(k, 'am') AND length(k) > 4 THEN left(k, length(k) - 2) || 'a' ELSE k END AS key FROM (SELECT p_partkey, {BASIC.format(c='p_type')} AS k FROM part)")
def fn_norm_tala(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.tala_key(F.col("p_type")).alias("key"))


@query(f"SELECT n_nationkey, {BASIC.format(c='n_name')} AS deity, {BASIC.format(c='n_name')} AS temple, {BASIC.format(c='n_name')} AS title FROM nation")
def fn_norm_deity_temple_title(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", tx.deity_key(F.col("n_name")).alias("deity"), tx.temple_key(F.col("n_name")).alias("temple"), tx.title_key(F.col("n_name")).alias("title"))


def _nest(c: str, rules) -> str:
    for a, b in rules:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT p_partkey, {_nest('lower(p_name)', tx.MATCHING_COLLAPSE)} AS collapsed FROM part")
def fn_collapse(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.replaced(F.lower("p_name"), tx.MATCHING_COLLAPSE).alias("collapsed"))


_BARE = r"regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g')"


@query(rf"SELECT p_partkey, trim(regexp_replace({_nest(_BARE, tx.IDENTITY_COLLAPSE)}, '\s+', ' ', 'g')) AS key FROM part")
def fn_identity_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.identity_key(F.col("p_name")).alias("key"))


def _match_sql() -> str:
    k = r"regexp_replace(regexp_replace(lower(p_name), '\b(saint|sri|swami|sir|dr|prof|smt)\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g')"
    for old, new in (("ksh", "ks"), ("chh", "c"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "p"), ("gh", "g"), ("jh", "j"), ("ch", "c"), ("kh", "k")):
        k = f"replace({k}, '{old}', '{new}')"
    tidy = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    raga = "k"
    for old, new in (("aa", "a"), ("ee", "i"), ("oo", "o"), ("uu", "u"), (" ", "")):
        raga = f"replace({raga}, '{old}', '{new}')"
    tala = f"CASE WHEN {tidy('k')} LIKE '%am' AND length({tidy('k')}) > 4 THEN regexp_replace({tidy('k')}, 'am$', 'a') ELSE {tidy('k')} END"
    return rf"""SELECT p_partkey, {tidy('k')} AS title, CASE WHEN {tidy('k')} IN ('tyagaraja', 'tyagarajar') THEN 'tyagaraja' WHEN contains(k, 'diksitar') THEN 'muttusvami diksitar' WHEN {tidy('k')} IN ('syama sastri', 'syama sastry') THEN 'syama sastri' ELSE {tidy('k')} END AS composer,
    {tidy(raga)} AS raga, CASE WHEN {tala} IN ('desadi', 'madyadi') THEN 'adi' ELSE {tidy(tala)} END AS tala, {tidy(r"regexp_replace(k, '^(?:(?:lord|goddess|sri|arulmigu)\s+)+', '')")} AS deity, {tidy(r"regexp_replace(k, '^(?:(?:sri|arulmigu|tiru)\s+)+', '')")} AS temple FROM (SELECT p_partkey, {k} AS k FROM part)"""


@query(_match_sql())
def fn_match_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", *[tx.match_key(F.col("p_name"), k).alias(k) for k in ("title", "composer", "raga", "tala", "deity", "temple")])


@query()
def fn_garbled_diacritics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.repaired(F.col("text")).alias("repaired"))


@query("SELECT doc_id, CASE WHEN l > 0 THEN 'latin' END AS script FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ɏḀ-ỿ]', '', 'g')) AS l FROM documents)")
def fn_detect_script_majority(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.main_script(F.col("text")).alias("script"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ɏḀ-ỿ]') THEN 'latin' END AS script FROM documents")
def fn_detect_script_first(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.first_script(F.col("text")).alias("script"))


@query("SELECT doc_id, length(trim(text)) < 10 AS garbled FROM documents")
def fn_is_garbled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.is_garbled(F.col("text")).alias("garbled"))


@query(r"""SELECT page_id, list_filter([CASE WHEN regexp_matches(x, '(?i)https?://[^\s<>"{}|\\^`\[\]]+') THEN 'url' END, CASE WHEN regexp_matches(x, '(?im)^(?:Copyright|\(c\)).*$') THEN 'copyright' END], lambda k: k IS NOT NULL) AS kinds FROM (SELECT page_id, url || chr(10) || coalesce(html, '') AS x FROM pages)""")
def fn_detect_patterns(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.pollution(F.concat_ws("\n", "url", F.coalesce("html", F.lit("")))).alias("kinds"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(url, '://') THEN 'url' END AS kind FROM pages) WHERE kind IS NOT NULL GROUP BY 1")
def agg_pattern_histogram(t: Tables) -> DataFrame:
    return t.pages.select(F.explode(tx.pollution(F.col("url"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, n FROM (SELECT doc_id, lang, length(text) AS n FROM documents) WHERE n > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE contains(text, 'icense'))")
def q_cleanup_preview(t: Tables) -> DataFrame:
    """Texts that a word marks for cleaning, with their lengths."""
    return t.documents.where(F.col("text").contains("icense")).select("doc_id", "lang", F.length("text").cast("long").alias("n")).where("n > 0")


CLEAN = "text"
for _pattern, _with in (
    (r"""(?i)https?://[^\s<>"{}|\\^`\[\]]+""", ""), (r"(?im)^(?:Source|From|Ref(?:erence)?|Courtesy|Credit)\s*[:–—-]\s*.+$", ""),
    (r"(?im)^(?:Meaning|Translation|Word[- ]by[- ]word|Explanation|Interpretation)\s*[:–—-]\s*.*$", ""), (r"(?im)^(?:©|Copyright|\(c\)).*$", ""),
    (r"(?im)^(?:Page|p\.?)\s*\d+\s*$", ""), ("﻿", ""), (r"\n{3,}", "\n\n"), (r"(?im)^(?:Raga|Tala|Composer|Language|Script|Adi Tala|Rupaka Tala)\s*[:–—-]\s*.+$", ""),
):
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern}', '{_with}', 'g')"


@query(f"SELECT doc_id, trim({CLEAN}, ' ') AS cleaned FROM documents")
def fn_clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.unpolluted(F.col("text")).alias("cleaned"))


@query("SELECT page_id, lower(split_part(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^www\\.', ''), '/', 1)) AS domain FROM pages".replace("\\\\", "\\"))
def fn_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.domain(F.col("url")).alias("domain"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def fn_checksum(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(nullif(trim(json_extract_string(props, '$.none')), ''), event_type) AS name FROM events")
def fn_json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.nullif(F.trim(F.get_json_object("props", "$.none")), F.lit("")), "event_type").alias("name"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"importId":"' || event_id || '"}' AS props FROM events""")
def fn_json_set(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "struct<k: long>")
    return t.events.select("event_id", F.to_json(parsed.withField("importId", F.col("event_id").cast("string"))).alias("props"))


@query("""SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS doc FROM customer""")
def fn_json_build(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("doc"))


@query("SELECT p_partkey, [p_brand, p_type] AS fields FROM part")
def fn_text_array(t: Tables) -> DataFrame:
    made = t.part.select("p_partkey", F.concat(F.lit("{"), F.concat_ws(",", "p_brand", "p_type"), F.lit("}")).alias("a"))
    return made.select("p_partkey", tx.text_array(F.col("a")).alias("fields"))


@query("SELECT p_partkey, p_size - 1 AS first, p_size + 2 AS last FROM part")
def fn_page_range(t: Tables) -> DataFrame:
    made = t.part.select("p_partkey", tx.page_range(F.concat_ws("-", "p_size", F.col("p_size") + 3)).alias("r"))
    return made.select("p_partkey", "r.first", "r.last")


@query("SELECT event_id, ts - INTERVAL 15 MINUTE AS since, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS elapsed_ms FROM events")
def fn_now_minus(t: Tables) -> DataFrame:
    """Times are parameters, never the clock."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.expr("timestamp'2024-01-01 00:00:00Z'"))
    return t.events.select("event_id", F.expr("ts - interval 15 minutes").alias("since"), ms.alias("elapsed_ms"))


@query("SELECT CAST(m AS INTEGER) AS number, CASE WHEN m <= 36 THEN 'M1' ELSE 'M2' END AS ma, ['R1 G1', 'R1 G2', 'R1 G3', 'R2 G2', 'R2 G3', 'R3 G3'][(m - 1) % 36 // 6 + 1] AS lower_half, ['D1 N1', 'D1 N2', 'D1 N3', 'D2 N2', 'D2 N3', 'D3 N3'][(m - 1) % 6 + 1] AS upper_half FROM range(1, 73) r(m)")
def fn_melakarta_scale(t: Tables) -> DataFrame:
    """The 72 parent scales by arithmetic on their number."""
    pairs = lambda a, b: F.array(*[F.lit(f"{a}{i} {b}{j}") for i in (1, 2, 3) for j in (1, 2, 3) if i <= j])
    m = F.col("number")
    df = t.spark.range(1, 73).select(F.col("id").cast("int").alias("number"))
    return df.select("number", F.when(m <= 36, "M1").otherwise("M2").alias("ma"), F.element_at(pairs("R", "G"), F.floor((m - 1) % 36 / 6).cast("int") + 1).alias("lower_half"), F.element_at(pairs("D", "N"), (m - 1) % 6 + 1).alias("upper_half"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' END AS name, CASE WHEN lang = 'en' THEN 'en' END AS code FROM documents")
def fn_iso_lang(t: Tables) -> DataFrame:
    name = F.when(F.col("lang") == "en", "english")
    return t.documents.select("doc_id", name.alias("name"), tx.language_code(name).alias("code"))


@query("SELECT event_id, event_type IN ('', 'unknown', 'na', 'n a', 'none') AS placeholder FROM events")
def fn_placeholder_raga(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").isin(*tx.PLACEHOLDERS).alias("placeholder"))


# --- linkage

NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part)"
RATIO = "CAST(trunc((1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100) AS INTEGER)"


@query(f"WITH {NAMES} SELECT a.name, b.name AS candidate, {RATIO.format(a='a.name', b='b.name')} AS score FROM n a, n b WHERE {RATIO.format(a='a.name', b='b.name')} > 50")
def fn_lev_ratio(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name"))
    return linkage.fuzzy(names, names, 50)


KNOWN = "k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_size < 20)"


@query(f"WITH {NAMES}, {KNOWN}, s AS (SELECT n.name, k.name AS candidate, {RATIO.format(a='n.name', b='k.name')} AS score FROM n, k WHERE n.name NOT IN (SELECT name FROM k)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS i FROM s WHERE score > 50), u AS (SELECT name, name AS candidate, 100 AS score FROM n WHERE name IN (SELECT name FROM k) UNION ALL SELECT name, candidate, score FROM r WHERE i <= 5) SELECT *, CASE WHEN score >= 90 THEN 'HIGH' WHEN score >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM u")
def er_resolve(t: Tables) -> DataFrame:
    known = t.part.where("p_type = 'ECONOMY' and p_size < 20").select(F.col("p_name").alias("name"))
    return linkage.resolve(t.part.select(F.col("p_name").alias("name")), known)


TITLES = "x AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS key, p_type AS owner FROM part WHERE length(replace(p_name, ' ', '')) >= 5)"


@query(f"WITH {TITLES} SELECT a.key AS a, a.owner AS owner_a, b.key AS b, b.owner AS owner_b, {RATIO.format(a='a.key', b='b.key')} AS score, a.owner IS NOT DISTINCT FROM b.owner AS same_owner FROM x a JOIN x b ON left(a.key, 4) = left(b.key, 4) AND (a.key < b.key OR (a.key = b.key AND a.owner < b.owner)) WHERE {RATIO.format(a='a.key', b='b.key')} >= CASE WHEN a.owner IS NOT DISTINCT FROM b.owner THEN 75 ELSE 85 END")
def dup_near_title(t: Tables) -> DataFrame:
    return linkage.duplicates_by_prefix(t.part.select(F.col("p_name").alias("title"), F.col("p_type").alias("owner")), width=4)


@query("SELECT replace(lower(p_name), ' ', '') AS key, count(*) AS titles, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_exact_title(t: Tables) -> DataFrame:
    return t.part.groupBy(linkage.compressed(F.col("p_name")).alias("key")).agg(F.count("*").alias("titles"), F.min("p_partkey").alias("first_id")).where("titles > 1")


@query("SELECT p_brand, p_type, count(*) AS works, count(*) * (count(*) - 1) // 2 AS pairs FROM part GROUP BY 1, 2")
def dup_by_metadata(t: Tables) -> DataFrame:
    """How many works agree in owner and kind; the pairs are counted, not made."""
    n = F.col("works")
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("works")).withColumn("pairs", F.expr("works * (works - 1) div 2")).select("p_brand", "p_type", n, "pairs")


@query(f"WITH {NAMES}, {KNOWN}, s AS (SELECT n.name, k.name AS id, {RATIO.format(a='n.name', b='k.name')} AS score, left(n.name, 3) = left(k.name, 3) AS same_owner FROM n, k), o AS (SELECT * FROM s WHERE score > CASE WHEN same_owner THEN 50 ELSE 60 END) SELECT name, id, score, same_owner FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY same_owner DESC, score DESC, id) AS i FROM (SELECT *, max(score) OVER (PARTITION BY name) AS top FROM o) WHERE score >= top - 5) WHERE i = 1")
def match_best(t: Tables) -> DataFrame:
    known = t.part.where("p_type = 'ECONOMY' and p_size < 20").select(F.col("p_name").alias("name"))
    pairs = linkage.fuzzy(t.part.select(F.col("p_name").alias("name")), known, 50)
    pairs = pairs.withColumn("same_owner", F.substring("name", 1, 3) == F.substring("candidate", 1, 3)).withColumnRenamed("candidate", "id")
    return linkage.best_match(pairs, "name", floors=(50, 60))


@query(f"WITH {NAMES}, {KNOWN} SELECT n.name, k.name AS candidate, round(0.5 * (1.0::DOUBLE - levenshtein(n.name, k.name)::DOUBLE / greatest(length(n.name), length(k.name))) + 0.3 * (CASE WHEN left(n.name, 1) = left(k.name, 1) THEN 1.0 ELSE 0.0 END + CASE WHEN right(n.name, 1) = right(k.name, 1) THEN 1.0 ELSE 0.0 END)::DOUBLE / 2.0 + 0.2 * 0.5, 6)::DOUBLE AS score FROM n JOIN k ON {RATIO.format(a='n.name', b='k.name')} > 60")
def variant_match(t: Tables) -> DataFrame:
    known = t.part.where("p_type = 'ECONOMY' and p_size < 20").select(F.col("p_name").alias("name"))
    pairs = linkage.fuzzy(t.part.select(F.col("p_name").alias("name")), known, 60)
    same = lambda f: F.when(f("name") == f("candidate"), 1.0).otherwise(0.0)
    score = linkage.variant_score(tx.similarity(F.col("name"), F.col("candidate")), same(lambda c: F.substring(c, 1, 1)), same(lambda c: F.substring(c, -1, 1)), F.lit(0.5))
    return pairs.select("name", "candidate", F.round(score, 6).alias("score"))


@query("SELECT source, md5(text) AS content, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_variants(t: Tables) -> DataFrame:
    """Equal texts of one source: the smallest id stays."""
    return t.documents.groupBy("source", F.md5("text").alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


# --- structure


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, length(text) AS chars FROM documents")
def st_lines(t: Tables) -> DataFrame:
    """Lines with their offsets; the last line's end is the text's length."""
    df = t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("chars"))
    return df


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS filled, max(length(line)) AS longest FROM l GROUP BY 1")
def st_line_stats(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return df.groupBy("doc_id").agg(F.count_if(F.trim("line") != "").alias("filled"), F.max(F.length("line")).cast("long").alias("longest"))


@query("WITH c AS (SELECT conv_id, turn, role, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM conversations WHERE trim(text) <> '') SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS section_no, upper(role) AS kind, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS occurrence, CAST(n AS INTEGER) AS n_lines FROM c")
def parse_structure(t: Tables) -> DataFrame:
    """Conversations written as texts with a header line a turn, parsed back into sections."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<"), F.upper("role"), F.lit(">\n"), "text").alias("x"))))
    docs = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda x: x["x"]), "\n").alias("text"))
    heads = tuple((k, rf"^<{k}>$") for k in ("USER", "ASSISTANT", "SYSTEM", "TOOL"))
    return structure.sections(docs, heads).drop("text")


@query("SELECT doc_id, 'latin' AS script, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-zÀ-ɏḀ-ỿ]'))) AS INTEGER) AS n_lines FROM documents WHERE regexp_matches(text, '[A-Za-zÀ-ɏḀ-ỿ]')")
def st_variants_script(t: Tables) -> DataFrame:
    return structure.by_script(t.documents).drop("text")


@query(r"WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[₀-₉]', '', 'g'), ' ')) AS x FROM documents), d AS (SELECT *, list_max(list_filter(range(1, len(x) + 1), lambda i: regexp_matches(x[i], '\p{Nd}'))) AS last FROM l), t AS (SELECT *, x[last + 1 :] AS tail FROM d), c AS (SELECT *, coalesce(len(list_filter(tail, lambda y: y <> '')) >= 2 AND list_sum(list_transform(tail, lambda y: length(y))) >= 40, false) AS cut FROM t) SELECT doc_id, CASE WHEN cut THEN array_to_string(x[1 : last], chr(10)) ELSE array_to_string(x, chr(10)) END AS text, cut AS trimmed FROM c")
def st_trailer_strip(t: Tables) -> DataFrame:
    return structure.without_trailer(t.documents)


@query("WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT l_orderkey, min(n) AS least, max(n) AS most FROM v GROUP BY 1), o AS (SELECT o_orderkey, CAST(2 AS BIGINT) AS n FROM orders) SELECT o_orderkey AS doc_id, n, least, most, CASE WHEN least IS NULL OR most = 0 THEN 'no-parse' WHEN least = n AND most = n THEN 'aligned' WHEN least = most AND least > n THEN 'template-undercount' WHEN least = most AND least < n THEN 'parser-undercount' WHEN most <= n THEN 'resplit-to-template' ELSE 'mixed' END AS category FROM o LEFT JOIN e ON l_orderkey = o_orderkey")
def triage_classify(t: Tables) -> DataFrame:
    variants = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), "l_returnflag").agg(F.count("*").alias("n")).select("doc_id", "n")
    return structure.triage(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(2).cast("long").alias("n")), variants)


@query("SELECT d.doc_id, coalesce(lang, source) AS lang, CASE WHEN quality IS NULL THEN 'quality' END AS filled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrich_fill_missing(t: Tables) -> DataFrame:
    """Only missing fields are filled, and it is recorded which."""
    df = t.documents.join(t.labels, "doc_id", "left")
    return df.select("doc_id", F.coalesce("lang", "source").alias("lang"), F.when(F.col("quality").isNull(), "quality").alias("filled"))


@query("SELECT conv_id, list(CASE WHEN n = 1 THEN role ELSE role || ' ' || n END ORDER BY turn) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def st_sections(t: Tables) -> DataFrame:
    df = ops.occurrence(t.conversations, ["conv_id", "role"], [F.col("turn")], "n")
    label = F.when(F.col("n") == 1, F.col("role")).otherwise(F.concat_ws(" ", "role", "n"))
    return df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", label.alias("label")))), lambda x: x["label"]).alias("labels"))
