"""Sources: CSV manifests, fetched pages, JSON payloads, local HTML files and flagged reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE = T.StructType([T.StructField("entityId", T.StringType()), T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("confidence", T.StringType()), T.StructField("matchedOn", T.StringType())])
#: One extracted work, as payloads carry it.
EXTRACTION = (
    "struct<title: string, alternateTitle: string, composer: string, musicalForm: string, ragas: array<struct<name: string, `order`: int, section: string>>, tala: string, "
    "sections: array<struct<type: string, `order`: int, label: string>>, lyricVariants: array<struct<language: string, script: string, sections: array<struct<sectionOrder: int, text: string>>>>, "
    "metadataBoundaries: array<struct<label: string, startOffset: int, endOffset: int>>, deity: string, temple: string, templeLocation: string, sourceUrl: string, sourceName: string, sourceTier: int, "
    "extractionMethod: string, extractionTimestamp: string, pageRange: string, checksum: string, title_normalized: string, composer_normalized: string, raga_normalized: string, tala_normalized: string>"
)


def clean_manifest(rows: DataFrame) -> DataFrame:
    """krithi, raga and hyperlink of the rows that have a title and an http address; header names in any case."""
    named = {c.strip().lower(): c for c in rows.columns}
    if missing := {"krithi", "hyperlink"} - set(named):
        raise ValueError(f"the manifest lacks {sorted(missing)}")
    get = lambda n: F.nullif(F.trim(F.col(f"`{named[n]}`")), F.lit("")) if n in named else F.lit(None).cast("string")
    df = rows.select(get("krithi").alias("krithi"), get("raga").alias("raga"), get("hyperlink").alias("hyperlink"))
    scheme, host = F.lower(F.try_parse_url("hyperlink", F.lit("PROTOCOL"))), F.try_parse_url("hyperlink", F.lit("HOST"))
    return df.where(F.col("krithi").isNotNull() & scheme.isin("http", "https") & host.isNotNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return clean_manifest(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, escape='"'))


def artefact_key(url: Column) -> Column:
    """The name under which a fetched page is kept."""
    return F.substring(F.sha2(url, 256), 1, 16)


def payloads(rows: DataFrame, column: str = "payload", schema: str = EXTRACTION) -> DataFrame:
    """The rows exploded by their payload, a JSON array; one that can't be read gives no row."""
    return rows.withColumn("extraction", F.explode(F.from_json(F.col(column), f"array<{schema}>", {"mode": "PERMISSIVE"})))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path and html of local or remote files."""
    return html_of(spark.read.format("binaryFile").load(path))


def html_of(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def flagged_report(spark: SparkSession, path: str) -> DataFrame:
    return flagged(spark.read.text(path))


def flagged(lines: DataFrame) -> DataFrame:
    """id and category of each line (value) of a report like ``- `id`: category``."""
    pattern = r"`?([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})`?[^A-Za-z]*([A-Za-z][\w-]*)?"
    df = lines.select(F.regexp_extract("value", pattern, 1).alias("id"), F.nullif(F.regexp_extract("value", pattern, 2), F.lit("")).alias("category"))
    return df.where("id <> ''").groupBy("id").agg(F.min("category").alias("category"))
