"""A text's whole structure in one go: boundaries of notes, sections, variants in other languages and scripts, in nested rows.

Every text is cut into lines once, and its lines meet once, by doc_id; all that follows are windows and groups within that
partitioning. Lines carry their places, so sections and boundaries tell where in the text they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..saving import saved
from .headers import INLINE_INDIC_SIGN, INLINE_SIGN, MEANS, NOTES, aligned_variants, header_of, language_of_script, meaning_of
from .layout import merged_twins

# What begins a passage of notes, if it stands first in its line.
BOUNDARIES = {
    "MEANING": r"(?iu)^(?:meaning(?!\s+of\b)|artha|artham|भावार्थ)\b",
    "GIST": r"(?iu)^(?:gist|summary)\b",
    "NOTES": r"(?iu)^(?:notes?(?!\s+(?:on|about|from|by|for)\b)|tippani)\b",
    "WORD_DIVISION": r"(?iu)^(?:word\s*division|pada\s*ccheda)\b",
    "VARIATIONS": r"(?iu)^(?:variations?|alternate\s*reading)\b",
}
# What a line of a page's frame holds, and patterns of such lines and of keys to a transcription.
FRAME_WORDS = (
    "powered by blogger", "newer post", "older post", "subscribe to", "post a comment", "blog archive", "link to this post", "posted by", "all rights reserved",
    "copyright", "skip to main", "related posts", "pronunciation guide", "a i i u u", "ch j jh", "ph b bh m",
)
FRAME_LINES = (r"^back$", r"^meaning of kriti", r"^updated on ", r"^[ऀ-ൿ]\s*,\s*[ऀ-ൿ]", r"^\([^)]*\s-\s[^)]*\)\s*$")
# Fixed value: the line that stands before a quick passage within its section.
QUICK_MARK = "[Madhyama Kala Sahitya]"
#: A boundary in a long text's first characters is a link to its notes, not their beginning.
EARLY, LONG = 200, 600
#: Prose behind a variant's last line with a digit of pronunciation: lines and characters from which it is cut.
TRAILER_LINES, TRAILER_CHARS = 2, 40
SUNG_DIGIT = r"[ऀ-෿]\p{Nd}"

SECTION = "struct<section_no int, kind string, text string, start int, end int>"


def _over(*more: str, upto: bool = False):
    w = Window.partitionBy("doc_id", *more)
    return w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0) if upto else w


def _in(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def read_lines(docs: DataFrame) -> DataFrame:
    """The filled lines of docs(doc_id, text): line_no, start, end, line, boundary and its length, label and rest, size of the text."""
    text = F.replace("text", F.lit("\\n"), F.lit("\n"))
    # what holds for the whole text is told once a text, before there are lines
    df = docs.select("doc_id", text.alias("text")).select("doc_id", F.length("text").alias("size"), F.col("text").rlike(INLINE_SIGN).alias("latin"), F.col("text").rlike(INLINE_INDIC_SIGN).alias("indic"), F.split("text", "\n").alias("raws"))
    df = df.select("doc_id", "size", "latin", "indic", F.posexplode("raws").alias("line_no", "raw"))
    df = df.withColumn("before", F.sum(F.length("raw") + 1).over(_over(upto=True)) - F.length("raw") - 1)
    before, bare = F.col("before"), F.regexp_replace("raw", r"(?U)\s+$", "")
    df = df.withColumn("start", before + F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))).withColumn("end", before + F.length(bare))
    df = df.withColumn("line", F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s+", ""), "[₀-₉]", "")).where((F.col("line") != "") & ~F.col("line").rlike("(?iu)" + "|".join((*FRAME_WORDS, *FRAME_LINES))))
    boundary, width = F.lit(None).cast("string"), F.lit(0)
    for label, pattern in BOUNDARIES.items():
        fits = F.col("line").rlike(pattern)
        boundary, width = F.when(fits, label).otherwise(boundary), F.when(fits, F.length(F.regexp_extract("line", pattern, 0))).otherwise(width)
    notes = F.col("line").rlike("^(?=" + "|".join(BOUNDARIES.values()) + ")")
    boundary, width = F.when(notes, boundary), F.when(notes, width).otherwise(0)
    df = df.withColumn("head", header_of(F.col("line"), F.col("latin"), F.col("indic")))
    rest = F.when(F.col("head").isNull(), F.col("line")).otherwise(F.col("head.rest"))
    return df.select("doc_id", "size", "line_no", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "line", boundary.alias("boundary"), width.alias("width"), F.col("head.label").alias("label"), rest.alias("rest"))


def _placed(df: DataFrame) -> DataFrame:
    """The lines with the part of the text each is of: -1 the canonical sections, 0 a text without any, 1 variants, 2 later variants."""
    upto, whole = _over(upto=True), _over()
    first = F.min(F.when(F.col("boundary").isNotNull(), F.col("start"))).over(whole)
    skipped = F.coalesce((first < EARLY) & (F.col("size") > LONG), F.lit(False)).cast("int")
    df = df.withColumn("after", F.count("boundary").over(upto) > skipped)
    df = df.withColumn("block", F.count("label").over(upto)).withColumn("of", F.last("label", ignorenulls=True).over(upto))
    foreign = (*MEANS, *NOTES)
    sung = F.col("of").isNotNull() & ~_in("of", foreign) & ~F.col("after") & (F.col("rest") != "")
    df = df.withColumn("sung", sung).withColumn("opens", F.min(F.when(F.col("sung"), F.col("block"))).over(whole))
    df = df.withColumn("ends", F.min(F.when(_in("label", foreign) & (F.col("block") > F.col("opens")), F.col("block"))).over(whole))
    canon = F.when(F.col("sung") & (F.col("block") < F.coalesce("ends", F.lit(1 << 60))), -1).when(F.col("opens").isNull() & ~F.col("after"), 0)
    # a variant is opened by its language, and closed by the notes
    indic = [k for k, (_, script) in MEANS.items() if script != "latin"]
    df = df.withColumn("noted", F.count_if(_in("label", NOTES)).over(upto))
    opened = F.when(F.col("after"), F.when(_in("label", indic), F.col("label")).when(_in("label", foreign) | (F.col("boundary").isNotNull() & (F.lag("after").over(_over().orderBy("line_no")) != F.col("after"))), "")).otherwise(F.when(_in("label", MEANS), F.col("label")))
    df = df.withColumn("tongue", F.last(opened, ignorenulls=True).over(upto)).withColumn("k", F.count(opened).over(upto))
    other = F.when((F.col("tongue") != "") & (F.col("after") | (F.col("noted") == 0)) & (F.col("rest") != ""), F.when(F.col("after"), 2).otherwise(1))
    meaning = meaning_of(F.col("tongue"))
    own = F.struct(canon.alias("part"), F.lit(0).cast("long").alias("k"), F.lit("").alias("language"), F.lit("").alias("script"))
    variant = F.struct(other.alias("part"), F.col("k"), meaning["language"].alias("language"), meaning["script"].alias("script"))
    df = df.withColumn("variant_no", F.explode(F.filter(F.array(own, variant), lambda v: v["part"].isNotNull())))
    kind = F.when(F.col("of").isNull() | _in("of", foreign) | (F.col("variant_no.part") == 0), "OTHER").otherwise(F.col("of"))
    body = F.when(F.col("variant_no.part") == 0, F.col("line")).otherwise(F.col("rest"))
    return df.select("doc_id", "variant_no", "line_no", F.when(F.col("variant_no.part") == 0, 0).otherwise(F.col("block")).alias("block"), kind.alias("kind"), body.alias("rest"), "start", "end")


def _sections(df: DataFrame) -> DataFrame:
    """doc_id (with the variant), section_no, kind, text, start and end. A quick passage goes into the section before it, or goes;
    of twins one stays."""
    quick = F.col("kind") == "MADHYAMA_KALA"
    upto = _over("variant_no", upto=True)
    df = df.withColumn("own", F.last(F.when(~quick, F.struct("block", "kind")), ignorenulls=True).over(upto)).where("own is not null")
    begins = quick & (F.lag("block").over(_over("variant_no").orderBy("line_no")) != F.col("block"))
    df = df.withColumn("rest", F.when(begins, F.concat(F.lit(f"\n{QUICK_MARK}\n"), "rest")).otherwise(F.col("rest")))
    made = df.groupBy("doc_id", "variant_no", "own").agg(F.array_sort(F.collect_list(F.struct("line_no", "rest"))).alias("rows"), F.min("start").alias("start"), F.max("end").alias("end"))
    place = F.row_number().over(Window.partitionBy("doc_id", "variant_no").orderBy("own.block"))
    made = made.select(F.struct("doc_id", "variant_no").alias("doc_id"), place.alias("section_no"), "own.kind", F.array_join("rows.rest", "\n").alias("text"), "start", "end")
    return merged_twins(made).select("doc_id.doc_id", "doc_id.variant_no", "section_no", "kind", "text", "start", "end")


def _by_script(canon: DataFrame) -> DataFrame:
    """Each script's lines of the canonical sections, as variants."""
    df = canon.select("doc_id", "section_no", "kind", "start", "end", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(tx.has_script(F.col("line"))).withColumn("script", tx.main_script(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("at", "line")))
    made = df.groupBy("doc_id", "script", "section_no", "kind", "start", "end").agg(rows.alias("rows"))
    variant = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("k"), language_of_script(F.col("script")).alias("language"), F.col("script"))
    return made.select("doc_id", variant.alias("variant_no"), "section_no", "kind", F.array_join("rows.line", "\n").alias("text"), "start", "end")


def _without_trailer(text: Column) -> Column:
    """The text up to its last line with a digit, if enough prose follows that."""
    rows = F.split(text, "\n")
    last = F.array_max(F.transform(rows, lambda x, i: F.when(x.rlike(SUNG_DIGIT), i + 1)))
    tail = F.slice(rows, last + 1, F.size(rows))
    cut = (F.size(tail) >= TRAILER_LINES) & (F.length(F.trim(F.array_join(tail, "\n"))) >= TRAILER_CHARS)
    return F.when(cut, F.array_join(F.slice(rows, F.lit(1), last), "\n")).otherwise(text)


def parse(docs: DataFrame) -> DataFrame:
    """doc_id; boundaries, an array of (start, end, label); sections, an array of (section_no, kind, text, start, end); variants, an
    array of (language, script, sections), for docs(doc_id, text), whose doc_ids are unique.

    Places count characters from 0, in the text with its written-out line ends (a backslash and an n) made real. Sections end at the
    first notes, or at the second language. A text without headers is one section OTHER. Variants come from language headers,
    else from the scripts of the sections' lines; behind the notes only Indic ones of new scripts do. A variant's sections take
    the places of the canonical ones of their kind. Null and blank texts have empty arrays. Lines and sections are each made once
    and saved, as boundaries, sections and variants are all read from them.
    """
    read = saved(read_lines(docs))
    made = saved(_sections(_placed(read)))
    canon = made.where("variant_no.part <= 0").drop("variant_no")
    told = made.where("variant_no.part > 0")
    named = told.where("variant_no.part = 1").select("doc_id").distinct()
    lined = aligned_variants(told, canon.select("doc_id", "section_no", "kind")).unionByName(_by_script(canon.join(named, "doc_id", "left_anti")))
    section = F.struct("section_no", "kind", "text", "start", "end")
    each = lined.groupBy("doc_id", "variant_no").agg(F.array_sort(F.collect_list(section)).alias("s"))
    n = F.size("s")
    trimmed = F.transform("s", lambda x, i: F.when((i > 0) & (i == n - 1), x.withField("text", _without_trailer(x["text"]))).otherwise(x))
    each = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("variant_no", trimmed.alias("sections")))).alias("v"))
    new = lambda v: (v["variant_no"]["part"] == 1) | ~F.exists("v", lambda w: (w["variant_no"]["part"] == 1) & (w["variant_no"]["script"] == v["variant_no"]["script"]))
    variants = F.transform(F.filter("v", new), lambda v: F.struct(v["variant_no"]["language"].alias("language"), v["variant_no"]["script"].alias("script"), v["sections"].alias("sections")))
    found = read.where("boundary is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("width")).alias("end"), F.col("boundary").alias("label")))).alias("boundaries"))
    out = docs.select("doc_id").join(found, "doc_id", "left").join(canon.groupBy("doc_id").agg(F.array_sort(F.collect_list(section)).alias("sections")), "doc_id", "left").join(each.select("doc_id", variants.alias("variants")), "doc_id", "left")
    empty = {"boundaries": "array<struct<start int, end int, label string>>", "sections": f"array<{SECTION}>", "variants": f"array<struct<language string, script string, sections array<{SECTION}>>>"}
    return out.select("doc_id", *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c, kind in empty.items()])
