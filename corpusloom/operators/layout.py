"""Steps on sections that are there already, spans of metadata, and segments of printed pages - by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .structure import METADATA, lines

#: Ratios of a title's type size to the body's, tried in this order until two titles are found.
TITLE_RATIOS = (1.3, 1.15, 1.05)


def demoted(sections: DataFrame, kind: str = "MADHYAMA_KALA") -> DataFrame:
    """Sections of the kind become the end of the section before them; the rest are renumbered.

    sections: doc_id, section_no, kind, text. One with nothing before it stays.
    """
    w = Window.partitionBy("doc_id").orderBy("section_no")
    own = (F.col("kind") != kind) | (F.row_number().over(w) == 1)
    df = sections.withColumn("own", own).withColumn("parent", F.sum(F.col("own").cast("int")).over(w))
    rows = F.array_sort(F.collect_list(F.struct("section_no", "kind", "text")))
    df = df.groupBy("doc_id", "parent").agg(rows.alias("rows"))
    return df.select("doc_id", F.col("parent").cast("int").alias("section_no"), F.element_at("rows.kind", 1).alias("kind"), F.array_join("rows.text", "\n").alias("text"))


def merged_twins(sections: DataFrame, least: float = 0.9) -> DataFrame:
    """Neighbours of one kind whose texts agree place by place are taken in pairs; of each pair the longer text stays.
    start and end, where given, are kept."""
    spans = [c for c in ("start", "end") if c in sections.columns]
    w = Window.partitionBy("doc_id").orderBy("section_no")
    twin = F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False)) & (tx.position_overlap(F.lag("text").over(w), F.col("text")) > least)
    df = sections.withColumn("run", F.sum(F.when(F.coalesce(twin, F.lit(False)), 0).otherwise(1)).over(w))
    df = df.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("section_no")) - 1) / 2))
    best = F.max_by(F.struct("section_no", "kind", "text", *spans), F.struct(F.length("text"), -F.col("section_no")))
    kept = df.groupBy("doc_id", "run", "pair").agg(best.alias("b"), F.min("section_no").alias("at"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return kept.select("doc_id", place.alias("section_no"), "b.kind", "b.text", *[f"b.{c}" for c in spans])


def raga_markers(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, raga and backward for lines that only name a raga (and whether the passage runs backwards)."""
    marker = r"(?iu)^\s*(?:\d+[.)]\s*)?(viloma\s*[-–:]?\s*)?([\p{L} ]+?)\s+r[aā]ga[mṁ]?\s*$"
    df = lines(docs).where(F.col("line").rlike(marker))
    return df.select("doc_id", "line_no", F.regexp_extract("line", marker, 2).alias("raga"), (F.regexp_extract("line", marker, 1) != "").alias("backward"))


def boundaries(docs: DataFrame, early: int = 200, long_text: int = 600) -> DataFrame:
    """doc_id, label, start and end of metadata lines; one in the first characters of a long text is not taken."""
    df = lines(docs.select("doc_id", "text")).join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
    label = F.lit(None).cast("string")
    for name, pattern in reversed(METADATA.items()):
        label = F.when(F.col("line").rlike(pattern), name).otherwise(label)
    df = df.withColumn("label", label).where("label is not null")
    df = df.where(~((F.col("start") < early) & (F.col("size") > long_text)))
    return df.select("doc_id", "label", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("line")).cast("int").alias("end"))


def segments(blocks: DataFrame) -> DataFrame:
    """doc_id, segment, title, first_page and text from blocks (doc_id, page, y0, font_size, is_bold, text).

    The body's type size is the one with most characters. Titles are bold blocks larger than the body by the first of
    TITLE_RATIOS that gives a document two titles or more. Pages with three or more dotted leaders are contents pages.
    """
    leaders = blocks.groupBy("doc_id", "page").agg(F.count_if(F.col("text").rlike(r"\.{4,}\s*\d+\s*$")).alias("leaders"))
    df = blocks.join(leaders, ["doc_id", "page"]).where("leaders < 3").drop("leaders")
    half = F.round(F.col("font_size") * 2) / 2
    body = df.groupBy("doc_id", half.alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    body = body.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", "size")).alias("body"))
    df = df.join(body, "doc_id").withColumn("over", F.when(F.col("is_bold"), F.col("font_size") / F.col("body")))
    found = df.groupBy("doc_id").agg(*[F.count_if(F.col("over") >= r).alias(f"n{i}") for i, r in enumerate(TITLE_RATIOS)])
    least = F.lit(TITLE_RATIOS[-1])
    for i in range(len(TITLE_RATIOS) - 1, -1, -1):
        least = F.when(F.col(f"n{i}") >= 2, TITLE_RATIOS[i]).otherwise(least)
    df = df.join(found.select("doc_id", least.alias("least")), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "text")
    title = F.coalesce(F.col("over") >= F.col("least"), F.lit(False))
    df = df.withColumn("is_title", title).withColumn("segment", F.sum(title.cast("int")).over(w)).where("segment > 0")
    rows = F.array_sort(F.collect_list(F.when(~F.col("is_title"), F.struct("page", "y0", "text"))))
    out = df.groupBy("doc_id", "segment").agg(F.max(F.when(F.col("is_title"), F.col("text"))).alias("title"), F.min("page").alias("first_page"), rows.alias("rows"))
    return out.select("doc_id", F.col("segment").cast("int").alias("segment"), "title", "first_page", F.array_join("rows.text", "\n").alias("text"))


def sound_variants(variants: DataFrame) -> DataFrame:
    """Variants (struct array column `variants` of language, script, sections) without empty sections and empty variants."""
    filled = F.transform("variants", lambda v: v.withField("sections", F.filter(v["sections"], lambda s: F.coalesce(F.trim(s["text"]) != "", F.lit(False)))))
    return variants.withColumn("variants", F.filter(filled, lambda v: F.size(v["sections"]) > 0))
