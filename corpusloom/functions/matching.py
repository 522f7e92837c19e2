"""String comparisons that Spark has no function for, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from .text import similarity


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, 0 to 100; null if either is."""
    return pd.Series([None if x is None or y is None else 100.0 * SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def longest_shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common run of characters, blanks aside."""

    def run(x: str | None, y: str | None) -> int:
        x, y = "".join((x or "").split()), "".join((y or "").split())
        return SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size

    return pd.Series([run(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Every run of letters capitalised, also behind apostrophes and digits."""
    return s.map(lambda t: t if t is None else t.title())


def start_of(c: Column, n: int = 500) -> Column:
    """The first n characters, letters and blanks only."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[^\p{L}\s]", ""), 1, n)


def ratio_of_starts(a: Column, b: Column, n: int = 500) -> Column:
    """Similarity in hundredths of the starts of both."""
    return (similarity(start_of(a, n), start_of(b, n)) * 100).cast("int")


def cut_to_bytes(c: Column, most: int) -> Column:
    """The longest start of at most so many UTF-8 bytes that ends at a character."""
    whole = F.octet_length(c) <= most
    octets = F.encode(c, "UTF-8")
    # Of the last bytes, drop a character that isn't whole: as many as follow its lead byte.
    lead = [F.conv(F.hex(F.substring(octets, most - k, 1)), 16, 10).cast("int") for k in range(4)]
    is_lead = [(x < 128) | (x >= 192) for x in lead]
    size = [F.when(x < 128, 1).when(x < 224, 2).when(x < 240, 3).otherwise(4) for x in lead]
    keep = F.when(whole, F.octet_length(c))
    for k in range(4):  # the lead byte is k bytes before the end
        keep = keep.when(is_lead[k], F.when(size[k] <= k + 1, most).otherwise(most - k - 1))
    return F.when(whole, c).otherwise(F.decode(F.substring(octets, F.lit(1), keep), "UTF-8"))


def composer_of_address(url: Column, hosts: dict[str, str]) -> Column:
    """The owner that a part of an address stands for."""
    out = F.lit(None).cast("string")
    for part, name in reversed(hosts.items()):
        out = F.when(F.lower(url).contains(part), name).otherwise(out)
    return out


# Endings of addresses and the formats they stand for.
FORMATS = {"pdf": "PDF", "docx": "DOCX", "doc": "DOCX", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "csv": "CSV", "json": "API"}


def format_of_address(url: Column) -> Column:
    ending = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("HTML")
    for end, name in FORMATS.items():
        out = F.when(ending == end, name).otherwise(out)
    return out


def swara_notation(c: Column) -> Column:
    """Notation with one blank between marks, no brackets, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\[\](){}]", ""), r"[\s,;|]+", " ")))


def needs_reading_by_eye(c: Column) -> Column:
    """So many replacement characters that the text was not extracted: 5 % and 20 with Devanagari, or 20 % and 200."""
    bad, n = F.length(F.regexp_replace(c, "[^�]", "")), F.greatest(F.length(c), F.lit(1))
    return ((bad / n >= 0.05) & (bad >= 20) & c.rlike("[ऀ-ॿ]")) | ((bad / n >= 0.20) & (bad >= 200))
