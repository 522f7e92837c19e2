"""Headers, variants, glyphs, page texts and repairs on fixtures that stand in the query and, as what must come out, in its SQL; and the
survey's last lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import glyphs
from ..functions import text as tx
from ..operators import headers, scoring, structure
from ..operators import tables as ops
from ..sources import html, readers
from .base import Tables, query
from .curation import VOTES, vote_run

#: Texts as sources have them: a work in Latin letters and two more scripts, one with inline labels, one with later variants.
TEXTS = (
    (1, "Sri Raga\nEnglish\nPallavi: vAtApi gaNapatim\nanupallavi\nbhUtAdi\n- Samashti Charanam\npurA kumbha\n(m.k)\nvItarAginam\nDevanagari\nवातापि गणपतिं\nअनुपल्लवि\nभूतादि\nसमष्टि चरणम्\nपुरा कुम्भ\nMeaning\nwords of prose\nTamil\nபல்லவி\nவாதாபி"),
    (2, "P giripai nelakonna\nA parama pAvanA\nC1 cara caranam\nC2 another one\nNotes: none"),
    (3, "A plain text\nP is a letter here\nanother line\nMeaning of Kriti-1"),
    (4, "प. गिरिपै\nअ. परम\nच1. चर\n[CHARANAM]\nx\nChittaswaram 2"),
    (5, "Telugu\nపల్లవి\nవాతాపి\n(మధ్యమ కాల సాహిత్యం)\nవీత\nKannada - \nಪಲ್ಲವಿ\nವಾತಾಪಿ"),
)


def texts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(TEXTS, "doc_id int, text string")


def values(columns: str, *rows: tuple) -> str:
    """SQL for the rows, as they must come out."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return f"[{', '.join(map(literal, v))}]"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"


@query(
    values(
        "doc_id, line_no, label, rest",
        (1, 1, 'ENGLISH', ''),
        (1, 2, 'PALLAVI', 'vAtApi gaNapatim'),
        (1, 3, 'ANUPALLAVI', ''),
        (1, 5, 'SAMASHTI_CHARANAM', ''),
        (1, 7, 'MADHYAMA_KALA', ''),
        (1, 9, 'DEVANAGARI', ''),
        (1, 11, 'ANUPALLAVI', ''),
        (1, 13, 'SAMASHTI_CHARANAM', ''),
        (1, 15, 'MEANING', ''),
        (1, 17, 'TAMIL', ''),
        (1, 18, 'PALLAVI', ''),
        (2, 0, 'PALLAVI', 'giripai nelakonna'),
        (2, 1, 'ANUPALLAVI', 'parama pAvanA'),
        (2, 2, 'CHARANAM', 'cara caranam'),
        (2, 3, 'CHARANAM', 'another one'),
        (2, 4, 'NOTES', 'none'),
        (3, 3, 'MEANING', 'of Kriti-1'),
        (4, 0, 'PALLAVI', 'गिरिपै'),
        (4, 1, 'ANUPALLAVI', 'परम'),
        (4, 2, 'CHARANAM', 'चर'),
        (4, 3, 'CHARANAM', ''),
        (4, 5, 'CHITTASWARAM', ''),
        (5, 0, 'TELUGU', ''),
        (5, 1, 'PALLAVI', ''),
        (5, 3, 'MADHYAMA_KALA', ''),
        (5, 5, 'KANNADA', ''),
        (5, 6, 'PALLAVI', ''),
    )
)
def st_headers(t: Tables) -> DataFrame:
    return headers.headers(texts(t)).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "label", "rest")


@query(
    values(
        "doc_id, variant_no, language, script, section_no, kind, text",
        (1, 1, 'en', 'latin', 1, 'PALLAVI', 'vAtApi gaNapatim'),
        (1, 1, 'en', 'latin', 2, 'ANUPALLAVI', 'bhUtAdi'),
        (1, 1, 'en', 'latin', 3, 'SAMASHTI_CHARANAM', 'purA kumbha\nvItarAginam'),
        (1, 2, 'sa', 'devanagari', 1, 'OTHER', 'वातापि गणपतिं'),
        (1, 2, 'sa', 'devanagari', 2, 'ANUPALLAVI', 'भूतादि'),
        (1, 2, 'sa', 'devanagari', 3, 'SAMASHTI_CHARANAM', 'पुरा कुम्भ'),
        (5, 1, 'te', 'telugu', 1, 'PALLAVI', 'వాతాపి\nవీత'),
        (5, 2, 'kn', 'kannada', 1, 'PALLAVI', 'ವಾತಾಪಿ'),
    )
)
def st_variants_lang(t: Tables) -> DataFrame:
    return headers.language_variants(texts(t))


@query(
    values(
        "doc_id, variant_no, language, script, section_no, kind, text",
        (1, 1, 'ta', 'tamil', 1, 'PALLAVI', 'வாதாபி'),
    )
)
def st_variants_post(t: Tables) -> DataFrame:
    return headers.later_variants(texts(t))


#: Sections of a work in two variants, and its canonical structure.
CANON = ((1, 1, "PALLAVI"), (1, 2, "ANUPALLAVI"), (1, 3, "CHARANAM"), (1, 4, "CHARANAM"))
VARIANTS = (
    (1, 1, 1, "OTHER", "title"), (1, 1, 2, "PALLAVI", "first"), (1, 1, 3, "CHARANAM", "third"), (1, 1, 4, "CHARANAM", "fourth"), (1, 1, 5, "CHARANAM", "fifth"),
    (1, 2, 1, "OTHER", "a"), (1, 2, 2, "OTHER", "b"), (1, 2, 3, "CHARANAM", "c"), (1, 2, 4, "SWARA_SAHITYA", "d"),
    (2, 1, 1, "PALLAVI", "of a work without structure"),
)


@query(
    values(
        "doc_id, variant_no, section_no, kind, text",
        (1, 1, 1, 'PALLAVI', 'title\nfirst'),
        (1, 1, 3, 'CHARANAM', 'third'),
        (1, 1, 4, 'CHARANAM', 'fourth'),
        (1, 2, 1, 'PALLAVI', 'a'),
        (1, 2, 2, 'ANUPALLAVI', 'b'),
        (1, 2, 3, 'CHARANAM', 'c'),
    )
)
def st_align_variant(t: Tables) -> DataFrame:
    variants = t.spark.createDataFrame(VARIANTS, "doc_id int, variant_no int, section_no int, kind string, text string")
    return headers.aligned_variants(variants, t.spark.createDataFrame(CANON, "doc_id int, section_no int, kind string"))


@query(
    values(
        "label, language, script, of_script",
        ('DEVANAGARI', 'sa', 'devanagari', 'sa'),
        ('ENGLISH', 'en', 'latin', 'en'),
        ('HINDI', 'hi', 'devanagari', 'sa'),
        ('KANNADA', 'kn', 'kannada', 'kn'),
        ('LATIN', 'en', 'latin', 'en'),
        ('MALAYALAM', 'ml', 'malayalam', 'ml'),
        ('SANSKRIT', 'sa', 'devanagari', 'sa'),
        ('TAMIL', 'ta', 'tamil', 'ta'),
        ('TELUGU', 'te', 'telugu', 'te'),
        ('WORD_DIVISION', 'en', 'latin', 'en'),
    )
)
def fn_script_lang(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(k,) for k in (*headers.MEANS, "WORD_DIVISION")], "label string").select("label", headers.meaning_of(F.col("label")).alias("m"))
    return df.select("label", "m.language", "m.script", headers.language_of_script(F.col("m.script")).alias("of_script"))


#: As the font's text layer has them: clusters, the sign on the left, vowels in two pieces, ligatures and marks.
SET = ((1, "rAm"), (2, "Efv"), (3, "E\x06t"), (4, "aApd"), (5, "fF\x0eF"), (6, '"mA'), (7, "Efvm,"), (8, "En\\dA"), (9, "(12)"), (10, ""), (11, None), (12, "EkE"))


@query(
    values(
        "id, text",
        (1, 'राम'),
        (2, 'शिव'),
        (3, 'न्ति'),
        (4, 'आपद'),
        (5, 'शीब्ी'),
        (6, 'क्षमा'),
        (7, 'शिवमः'),
        (8, 'निंदा'),
        (9, '(12)'),
        (10, ''),
        (11, None),
        (12, 'किि'),
    )
)
def fn_velthuis(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame(SET, "id int, raw string")
    return df.select("id", glyphs.decoded(F.col("raw")).alias("text"))


@query(
    values(
        "page_id, title, text",
        (1, 'Tx', 'One\nTwo link (http://h.org/x) near'),
        (2, None, 'one two\nthree\nfour\nfive\nsix'),
        (3, None, 'art same other (http://o.org/) none'),
        (4, None, 'x\nTamil y z rel (/r)'),
        (5, None, ''),
        (6, None, 'a b c & d\ne\n\n f\ng'),
    )
)
def html_extract_fixture(t: Tables) -> DataFrame:
    df = html.extract_pages(t.spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    return df.withColumn("page_id", F.col("page_id").cast("int"))


#: Pages with each rule of the extraction.
PAGES = (
    (1, "http://h.org/p", "<html><title> T <b>x</b></title><body>out<nav>menu</nav><div class='post-body'>One<br>Two <a href='/x'>link</a> <a href='#v'>near</a><table id='english'><tr><td>English</td></tr></table><script>x()</script></div><footer>f</footer></body></html>"),
    (2, "http://h.org/p", "<body><article>a</article><div class='post wide'><p>one <i>two</i><p>three<ul><li>four<li>five</ul>six</div></body>"),
    (3, "http://h.org/p", "<body><div class='post-body'> </div><article>art<a href='http://h.org/p?x'>same</a><a href='http://o.org/'>other</a><a href=''>none</a><a href='/n'>Notation</a></article></body>"),
    (4, None, "<p>x</p><table><tr><td>Tamil</td><td>Telugu</td><td>z</td></tr></table><table><tr><td>Tamil</td><td>y</td><td>z</td></tr></table><a href='/r'>rel</a>"),
    (5, "http://h.org/", None),
    (6, "http://h.org/", "<body>a  b\t\tc &amp; d<pre>e\n\n\n f</pre><header>h</header></p>g"),
)


@query(
    values(
        "doc_id, i, name, \"order\", section",
        (1, 0, 'SrI', 1, 'pallavi'),
        (1, 1, 'Arabhi', 2, 'charanam'),
        (2, 0, 'todi', None, None),
        (3, 0, 'todi', None, None),
        (4, 0, None, None, None),
    )
)
def build_ragas(t: Tables) -> DataFrame:
    marker = "struct<name: string, `order`: int, section: string, backward: boolean>"
    rows = [(1, [("SrI", 1, "PALLAVI", False), ("Arabhi", 2, "CHARANAM", False), ("mOhana", 3, "CHARANAM", True)], "x"), (2, [("mOhana", 1, "CHARANAM", True)], "todi"), (3, [], "todi"), (4, None, None)]
    df = t.spark.createDataFrame(rows, f"doc_id int, markers array<{marker}>, raga string").select("doc_id", F.posexplode(structure.ragas_of(F.col("markers"), F.col("raga"))).alias("i", "r"))
    return df.select("doc_id", "i", "r.name", "r.order", "r.section")


@query(
    values(
        "doc_id, reason, prepend, split, deferred",
        (1, None, ['PALLAVI', 'ANUPALLAVI'], ['en', 'sa'], ['ta', 'te']),
        (2, 'no en variant parsed', None, None, None),
        (3, 'variants disagree', None, None, None),
        (4, 'delta not in range', None, None, None),
        (5, 'prepended kinds', None, None, None),
        (6, 'en variant failed its gate', None, None, None),
        (7, 'not a clean prepend', None, None, None),
    )
)
def template_repair_plan(t: Tables) -> DataFrame:
    p, a, c = "PALLAVI", "ANUPALLAVI", "CHARANAM"
    works = [(1, [c]), (2, [c]), (3, [c]), (4, [a, c]), (5, [c]), (6, [c]), (7, [c])]
    variants = [
        (1, "en", [p, a, c], 100, True), (1, "ta", [p, a, c], 250, True), (1, "te", [p, a, c], 90, False), (1, "sa", [p, a, c], 90, True),
        (2, "ta", [p, c], 10, True), (3, "en", [p, c], 10, True), (3, "ta", [a, c], 10, True), (4, "en", [p, c], 10, True), (4, "ta", [p, c], 10, True),
        (5, "en", [c, c], 10, True), (6, "en", [p, c], 10, False), (7, "en", [p, c, a], 10, True),
    ]
    return structure.template_repairs(t.spark.createDataFrame(works, "doc_id int, kinds array<string>"), t.spark.createDataFrame(variants, "doc_id int, language string, kinds array<string>, last int, preserved boolean"))


@query(
    values(
        "doc_id, reason",
        (1, None),
        (2, 'differs from the template'),
        (3, 'no trailer removed'),
        (4, 'tail too short'),
        (5, 'tail carries lyric markers'),
        (6, 'weak overlap'),
        (7, 'not parsed'),
    )
)
def trailer_repair_plan(t: Tables) -> DataFrame:
    song, prose = "a song of twenty letters and more", " and then a translation in long and plain prose"
    rows = [(1, ["P"], ["P"], song + prose, song, song, song), (2, ["P"], ["A"], song + prose, song, song, song), (3, ["P"], ["P"], song, song, song, song), (4, ["P"], ["P"], song + " short", song, song, song), (5, ["P"], ["P"], song + prose + " த4", song, song, song), (6, ["P"], ["P"], song + prose, song, song, "quite another text"), (7, ["P"], None, None, None, None, song)]
    return structure.trailer_repairs(t.spark.createDataFrame(rows, "doc_id int, template array<string>, kinds array<string>, full_last string, cut_last string, text string, stored string"))


# --- over the driver's tables


@query(f"WITH {VOTES} SELECT work, consensus, consensus_type, confidence, NULL AS reviewer FROM f UNION ALL SELECT work, list_distinct(consensus), 'MANUAL', 'HIGH', 'r' FROM f WHERE confidence = 'LOW'".replace("list_distinct(consensus)", "consensus[1:1]"))
def vote_override(t: Tables) -> DataFrame:
    """A reviewer sets the structure of each doubtful vote to its first section: a row more, beside the old one."""
    votes = vote_run(t)
    overrides = votes.where("confidence = 'LOW'").select("work", F.slice("consensus", 1, 1).alias("structure"), F.lit("r").alias("reviewer"))
    return scoring.overridden(votes, overrides).select("work", "consensus", "consensus_type", "confidence", "reviewer")


@query("WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_discount * 100 AS INTEGER) AS confidence FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Unknown') AS title, confidence, (SELECT count(*) FROM m) AS total FROM (SELECT * FROM m ORDER BY confidence DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET 50) LEFT JOIN part ON p_partkey = l_partkey")
def q_variant_list(t: Tables) -> DataFrame:
    """The second page of matches with a status, best first, with titles and the number of all."""
    some = ops.where_in(t.lineitem, "l_returnflag", ["A", "R"], ["A", "N", "R"]).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 100).cast("int").alias("confidence"))
    page = ops.page(some, [F.col("confidence").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 1, 50)
    df = page.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    return df.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("Unknown")).alias("title"), "confidence", some.agg(F.count("*")).scalar().alias("total"))


@query("SELECT r_regionkey AS id, r_name AS name, count(n_nationkey) AS works FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q_sampradaya(t: Tables) -> DataFrame:
    """Every lineage by name, with the number of works that name it."""
    df = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return df.groupBy(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("works")).orderBy("name")


@query("WITH c AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1) SELECT p.page_id, c.page_id AS cached, p.page_id = c.page_id AS fresh FROM pages p LEFT JOIN c ON p.url = c.url")
def q_temple_cache(t: Tables) -> DataFrame:
    """Each address is fetched once: later pages find it in the cache."""
    cache = t.pages.where("url is not null").groupBy("url").agg(F.min("page_id").alias("cached"))
    return t.pages.join(cache, "url", "left").select("page_id", "cached", (F.col("page_id") == F.col("cached")).alias("fresh"))


@query(r"WITH v AS (SELECT page_id, url, regexp_matches(url, '^(?i)https?://[^/?#\s]+') AS ok FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i FROM v) SELECT page_id, CASE WHEN url IS NULL OR NOT ok THEN 'FAILED' WHEN i > 1 THEN 'EXISTS' ELSE 'CREATED' END AS outcome, CASE WHEN ok AND i = 1 THEN left(sha256(url), 16) END AS artefact FROM f")
def qs_scrape_stage(t: Tables) -> DataFrame:
    """The stage's tables without the fetching: a task with a sound address creates an import, unless there is one."""
    df = ops.occurrence(t.pages.select("page_id", "url"), ["url"], [F.col("page_id")], "i")
    ok = F.coalesce(F.col("url").rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))
    return df.select("page_id", F.when(~ok, "FAILED").when(F.col("i") > 1, "EXISTS").otherwise("CREATED").alias("outcome"), F.when(ok & (F.col("i") == 1), readers.artefact_key(F.col("url"))).alias("artefact"))


@query("SELECT page_id, length(html) AS chars, md5(html) AS digest FROM pages")
def src_html_files(t: Tables) -> DataFrame:
    """Pages as files have them, octets, decoded."""
    files = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    df = readers.html_of(files)
    return df.select(F.col("path").cast("long").alias("page_id"), F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


@query("SELECT lower(printf('%08x-0000-4000-8000-%012x', l_orderkey, l_linenumber)) AS id, min(lower(l_returnflag) || '-flag') AS category FROM lineitem GROUP BY 1")
def src_flagged_md(t: Tables) -> DataFrame:
    """Lines of a report, one an order's line, read back."""
    id_ = F.format_string("%08x-0000-4000-8000-%012x", "l_orderkey", "l_linenumber")
    return readers.flagged(t.lineitem.select(F.concat(F.lit("- `"), id_, F.lit("`: "), F.lower("l_returnflag"), F.lit("-flag")).alias("value")))


@query("SELECT n_nationkey AS id, n_name AS name, FALSE AS is_new FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, TRUE FROM region")
def sink_insert(t: Tables) -> DataFrame:
    """Rows are appended as they are."""
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(False).alias("is_new"))
    return ops.insert(old, t.region.select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit(True).alias("is_new")))
