"""Sections that plain header lines open: a fixed list of whole-line names, without gates, variants or notes.

Blanks, cases and ends of lines are those of the rules' own ASCII: no-break spaces, vertical tabs and separators are characters of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..saving import saved

# Lines that open a part by their exact words, patterns of those that open a section, and what a page's frame holds.
PARTS = ("English", "Tamil", "Meaning")
_TAIL = r"[.:\t\n\f\r \-]*\z"
_HEADS = {"PALLAVI": r"^(?:pallavi|p|பல்லவி)", "ANUPALLAVI": r"^(?:anupallavi|a|அனுபல்லவி)", "CHARANAM": r"^(?:ch?|(?:charanam|சரணம்)(?:[\t\n\f\r ][0-9]+)?)"}
_FRAME = (
    r"powered by blogger|(?:newer|older) post|related posts|subscribe to|post a comment|blog archive|link to this post|posted by|all rights reserved|copyright|skip to main"
    r"|pronunciation guide|a i i u u|ch j jh|ph b bh m|^back\z|^meaning of kriti|^updated on |^\([^)]*[\t\n\f\r ]-[\t\n\f\r ][^)]*\)\z"
)


def _folded(pattern: str) -> str:
    """The pattern for any case: ASCII letters, and the two characters beyond them that are cases of k and s."""
    cases = {"k": "[kK]", "s": "[sſ]"}
    out = "".join(cases.get(c, c) if before != "\\" else c for c, before in zip(pattern, " " + pattern, strict=False))
    return "(?i)" + out


HEADS, FRAME = {k: _folded(v) + _TAIL for k, v in _HEADS.items()}, _folded(_FRAME)


def label_of(line: Column) -> Column:
    label = F.when(line.isin(*PARTS), F.upper(line))
    for kind, pattern in HEADS.items():
        label = label.when(line.rlike(pattern), kind)
    return label


def headed_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, kind and text for docs(doc_id, text), whose doc_ids are unique; rows without a doc_id have no sections.

    Lines are trimmed; empty ones and those of a page's frame go. A header line opens a section; sections without lines, and lines
    before the first header, go. Where no line stands behind a header, all lines, headers too, are one section OTHER.
    """
    line = lambda x: F.btrim(x, F.lit(" \t\r"))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: (x != "") & ~x.rlike(FRAME))
    # saved, as a plan that reads the lines several times would cut and look through the texts as often
    df = saved(docs.where("doc_id is not null and text is not null").select("doc_id", lines.alias("lines"))).where(F.size("lines") > 0)
    df = df.withColumn("told", F.exists("lines", lambda x: label_of(x).isNotNull()))
    other = lambda d: d.select("doc_id", F.lit(1).alias("section_no"), F.lit("OTHER").alias("kind"), F.array_join("lines", "\n").alias("text"))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where("told").select("doc_id", F.posexplode("lines").alias("line_no", "line")).withColumn("label", label_of(F.col("line")))
    rows = rows.withColumn("block", F.count("label").over(upto)).withColumn("kind", F.last("label", ignorenulls=True).over(upto))
    headed = F.max(F.col("label").isNull() & (F.col("block") > 0)).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("headed", headed).where("not headed or (label is null and block > 0)")
    block, kind = F.when(F.col("headed"), F.col("block")).otherwise(0), F.when(F.col("headed"), F.col("kind")).otherwise("OTHER")
    made = rows.groupBy("doc_id", block.alias("block"), kind.alias("kind")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block"))
    return other(df.where("not told")).unionByName(made.select("doc_id", place.alias("section_no"), "kind", F.array_join("rows.line", "\n").alias("text")))
