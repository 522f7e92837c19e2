"""Judgements on short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that head a book's parts rather than a work.
PART_TITLES = ("index", "contents", "introduction", "preface", "foreword", "glossary", "bibliography", "appendix")


def valid_title(c: Column) -> Column:
    """Long enough, and not the head of a book's part."""
    bare = F.lower(F.trim(c))
    return (F.length(bare) >= 3) & ~bare.isin(*PART_TITLES)
