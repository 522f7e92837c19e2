"""Texts to sections: lines, headers, blocks carried from a header to the next, sections numbered by kind.

All of it is windows and grouping over exploded lines; a text's lines stay in one window, ordered by their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Labels of a text's head, each with the pattern of its value.
METADATA = {
    "raga": r"(?imu)^\s*r[aā]ga[mṁ]?\s*[:–—-]\s*(.+)$",
    "tala": r"(?imu)^\s*t[aā][lḷ]a[mṁ]?\s*[:–—-]\s*(.+)$",
    "composer": r"(?imu)^\s*composer\s*[:–—-]\s*(.+)$",
    "deity": r"(?imu)^\s*deity\s*[:–—-]\s*(.+)$",
    "temple": r"(?imu)^\s*temple\s*[:–—-]\s*(.+)$",
}


def line_order():
    return Window.partitionBy("doc_id").orderBy("line_no")


def metadata(text: Column) -> dict[str, Column]:
    return {name: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit("")) for name, pattern in METADATA.items()}


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line without outer blanks and subscript digits, and start: where it begins in the text."""
    parts = F.split("text", "\n")
    df = docs.select("doc_id", F.posexplode(parts).alias("line_no", "raw"))
    before = F.sum(F.length("raw") + 1).over(line_order().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("start", F.coalesce(before, F.lit(0)))
    return df.withColumn("line", F.trim(F.regexp_replace("raw", "[₀-₉]", ""))).drop("raw")


def header(line: Column, headers: tuple[tuple[str, str], ...]) -> Column:
    """The kind of section that the line begins, or null; the first pattern that fits."""
    return reduce(lambda out, h: F.when(line.rlike(h[1]), h[0]).otherwise(out), reversed(headers), F.lit(None).cast("string"))


def sections(docs: DataFrame, headers: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, section_no (from 1), kind, occurrence (of its kind), n_lines and text of each section.

    Lines before the first header are of kind OTHER. What a header's line says beside its label belongs to its section. headers:
    (kind, pattern) pairs, whose lines' rest stands behind a colon; by default those of operators.headers.
    """
    if headers is None:
        from .headers import labelled

        df = labelled(docs).withColumnRenamed("label", "head")
    else:
        df = lines(docs).withColumn("head", header(F.col("line"), headers))
        df = df.withColumn("rest", F.when(F.col("head").isNull(), F.col("line")).otherwise(F.trim(F.regexp_extract("line", r":\s*(.+)$", 1))))
    upto = line_order().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("block", F.count("head").over(upto)).withColumn("kind", F.coalesce(F.last("head", ignorenulls=True).over(upto), F.lit("OTHER")))
    made = df.withColumnRenamed("rest", "body").where("body <> ''")
    made = made.groupBy("doc_id", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("rows"))
    order = Window.partitionBy("doc_id").orderBy("block")
    kind = Window.partitionBy("doc_id", "kind").orderBy("block")
    made = made.withColumn("section_no", F.row_number().over(order)).withColumn("occurrence", F.row_number().over(kind))
    return made.select("doc_id", "section_no", "kind", "occurrence", F.size("rows").alias("n_lines"), F.array_join("rows.body", "\n").alias("text"))


def by_script(docs: DataFrame) -> DataFrame:
    """doc_id, script, n_lines and text: each script's lines of a text, in order."""
    df = lines(docs).where(tx.has_script(F.col("line"))).withColumn("script", tx.main_script(F.col("line")))
    made = df.groupBy("doc_id", "script").agg(F.count("*").cast("int").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return made.select("doc_id", "script", "n_lines", F.array_join("rows.line", "\n").alias("text"))


def aligned(variant: DataFrame, canon: DataFrame) -> DataFrame:
    """The n-th section of a kind in a variant, with the n-th of that kind in the canonical structure."""
    c = canon.select("doc_id", "kind", "occurrence", F.col("section_no").alias("canon_no"))
    return variant.join(c, ["doc_id", "kind", "occurrence"], "left").select("doc_id", "section_no", "kind", "occurrence", "canon_no")


def without_trailer(docs: DataFrame, least_lines: int = 2, least_chars: int = 40) -> DataFrame:
    """Texts cut behind their last line with a digit, if so much prose follows it."""
    df = lines(docs).withColumn("last_digit", F.max(F.when(F.col("line").rlike(r"\p{Nd}"), F.col("line_no"))).over(Window.partitionBy("doc_id")))
    tail = F.col("line_no") > F.col("last_digit")
    found = df.groupBy("doc_id").agg(F.count_if(tail & (F.col("line") != "")).alias("n"), F.sum(F.when(tail, F.length("line")).otherwise(0)).alias("chars"), F.array_sort(F.collect_list(F.struct("line_no", "line", tail.alias("tail")))).alias("rows"))
    cut = (F.col("n") >= least_lines) & (F.col("chars") >= least_chars)
    kept = F.when(cut, F.filter("rows", lambda r: ~F.coalesce(r["tail"], F.lit(False)))).otherwise(F.col("rows"))
    return found.select("doc_id", F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("text"), F.coalesce(cut, F.lit(False)).alias("trimmed"))


def triage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Why structures differ. expected: doc_id, n (the template); actual: doc_id, n (a variant's parsed sections)."""
    each = actual.groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("variants"))
    df = expected.join(each, "doc_id", "left")
    n, lo, hi = F.col("n"), F.col("least"), F.col("most")
    kind = F.when(lo.isNull() | (hi == 0), "no-parse").when((lo == n) & (hi == n), "aligned").when((lo == hi) & (lo > n), "template-undercount").when((lo == hi) & (lo < n), "parser-undercount").when(hi <= n, "resplit-to-template").otherwise("mixed")
    return df.select("doc_id", "n", "least", "most", kind.alias("category"))


def template_repairs(works: DataFrame, variants: DataFrame, prepends: tuple[str, ...] = ("PALLAVI", "ANUPALLAVI"), most: int = 2, trailer: float = 2.0) -> DataFrame:
    """What a repair would put before each work's template, or why it would not; gates come before any change.

    works: doc_id, kinds (the template); variants: doc_id, language, kinds (as parsed), last (length of the last section), preserved (whether
    the stored text is kept). The English variant leads; all must have its kinds; up to `most` kinds of `prepends` may be
    missing before the template, and nothing else. A variant whose last section is too long, or that loses text, waits.
    """
    lead = F.max_by(F.struct("kinds", "last", "preserved"), F.when(F.col("language") == "en", 1))
    each = variants.groupBy("doc_id").agg(lead.alias("en"), F.count_if(F.col("language") == "en").alias("leads"), F.collect_set("kinds").alias("all"), F.sort_array(F.collect_list(F.struct("language", "last", "preserved"))).alias("variants"))
    df = works.join(each, "doc_id", "left")
    full, k = F.col("en.kinds"), F.size("en.kinds") - F.size("kinds")
    ahead = F.slice(full, F.lit(1), F.greatest(k, F.lit(0)))
    late = F.filter("variants", lambda v: ((F.col("en.last") > 0) & (v["last"] > trailer * F.col("en.last"))) | ~v["preserved"])
    names = lambda x: F.transform(x, lambda v: v["language"])
    reason = (
        F.when(F.coalesce("leads", F.lit(0)) == 0, "no en variant parsed")
        .when(F.size("all") > 1, "variants disagree")
        .when(~k.between(1, most), "delta not in range")
        .when(F.slice(full, k + 1, F.size("kinds")) != F.col("kinds"), "not a clean prepend")
        .when(F.exists(ahead, lambda t: ~t.isin(*prepends)), "prepended kinds")
        .when(F.array_contains(names(late), "en"), "en variant failed its gate")
    )
    ok = reason.isNull()
    return df.select("doc_id", reason.alias("reason"), F.when(ok, ahead).alias("prepend"), F.when(ok, F.array_except(names("variants"), names(late))).alias("split"), F.when(ok, names(late)).alias("deferred"))


def trailer_repairs(works: DataFrame, least_chars: int = 40, least_run: int = 20) -> DataFrame:
    """doc_id and reason (null: the repair is safe) for variants whose last section ends in foreign prose.

    works: doc_id, template and kinds (arrays), full_last and cut_last (the last section before and after the cut), text (all that
    is left) and stored (the text in store). What was cut must be prose of some length, without the digits of sung text, and
    the rest must share a run of `least_run` characters with what is in store, blanks aside.
    """
    from ..functions.matching import longest_shared_run

    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    gone = F.trim(F.substring("full_last", F.length("cut_last") + 1, F.length("full_last")))
    reason = (
        F.when(F.col("kinds").isNull(), "not parsed")
        .when(F.col("kinds") != F.col("template"), "differs from the template")
        .when(F.col("full_last") == F.col("cut_last"), "no trailer removed")
        .when(F.length(gone) < least_chars, "tail too short")
        .when(gone.rlike("[ऀ-෿][0-9]"), "tail carries lyric markers")
        .when(F.coalesce("run", F.lit(0)) < least_run, "weak overlap")
    )
    return works.withColumn("run", longest_shared_run(bare(F.col("text")), bare(F.col("stored")))).select("doc_id", reason.alias("reason"))


def ragas_of(markers: Column, raga: Column) -> Column:
    """Array of (name, order, section): the markers (name, order, section, backward) that don't run backwards, else the one raga."""
    kept = F.transform(F.filter(F.coalesce(markers, F.array()), lambda m: ~m["backward"]), lambda m: F.struct(m["name"].alias("name"), m["order"].alias("order"), F.lower(m["section"]).alias("section")))
    one = F.array(F.struct(raga.alias("name"), F.lit(None).cast("int").alias("order"), F.lit(None).cast("string").alias("section")))
    return F.when(F.size(kept) > 0, kept).otherwise(one)
