"""Scalar functions on names and texts. All are Column to Column; only NFD decomposition needs Python (Arrow)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of Latin transliteration and their plain forms, then marks that go.
PLAIN_FROM = "āĀīĪūŪēĒōŌṭṬḍḌṇṆṅṄñÑśŚṣṢṃṂḥḤṛṚṝṜḷḶँंः"
PLAIN_TO = "aAiIuUeEoOtTdDnNnNnNsSsSmMhHrRrRlL"
# Titles of respect that names are compared without.
HONORIFICS = "saint|sri|swami|sir|dr|prof|smt"
# Ordered transliteration collapses.
CORE_COLLAPSE = (("ksh", "ks"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "p"), ("gh", "g"), ("jh", "j"), ("ch", "c"))
ASPIRATE = (("kh", "k"),)
LONG_VOWELS = (("aa", "a"), ("ee", "i"), ("oo", "o"), ("uu", "u"))
MATCHING_COLLAPSE = (*CORE_COLLAPSE[:1], ("chh", "c"), *CORE_COLLAPSE[1:], *ASPIRATE)
IDENTITY_COLLAPSE = (*CORE_COLLAPSE, *ASPIRATE, *LONG_VOWELS)
# Standalone diacritics of extracted print, and what they stand for; then consonants with a dot below.
GARBLED = ((r"¯\s*a", "ā"), (r"¯\s*[iı]", "ī"), (r"¯\s*u", "ū"), (r"\s*˙\s*m", "ṁ"), (r"\s*˙\s*n", "ṅ"), (r"\s*˙\s*r", "ṛ"), (r"´\s*s", "ś"), (r"˜\s*n", "ñ"), (r"✠", ""), (r"\n\s*\d+\s*$", "\n"), (r"ı", "i"))
DOTTED = (("s", "ṣ"), ("n", "ṇ"), ("d", "ḍ"), ("t", "ṭ"), ("l", "ḷ"), ("r", "ṛ"), ("h", "ḥ"))
# What pollutes texts.
POLLUTION = {
    "url": r'(?i)https?://[^\s<>"{}|\\^`\[\]]+',
    "attribution": r"(?im)^(?:Source|From|Ref(?:erence)?|Courtesy|Credit)\s*[:–—-]\s*.+$",
    "meaning": r"(?im)^(?:Meaning|Translation|Word[- ]by[- ]word|Explanation|Interpretation)\s*[:–—-]\s*.*$",
    "copyright": r"(?im)^(?:©|Copyright|\(c\)).*$",
    "page_number": r"(?im)^(?:Page|p\.?)\s*\d+\s*$",
    "bom": "﻿",
    "blank_run": r"\n{3,}",
    "header": r"(?im)^(?:Raga|Tala|Composer|Language|Script|Adi Tala|Rupaka Tala)\s*[:–—-]\s*.+$",
}
# Unicode blocks of the scripts.
SCRIPTS = {"devanagari": "ऀ-ॿ", "tamil": "஀-௿", "telugu": "ఀ-౿", "kannada": "ಀ-೿", "malayalam": "ഀ-ൿ", "latin": "A-Za-zÀ-ɏḀ-ỿ"}
LANGUAGE_CODES = {"sanskrit": "sa", "tamil": "ta", "telugu": "te", "kannada": "kn", "malayalam": "ml", "hindi": "hi", "english": "en"}
PLACEHOLDERS = ("", "unknown", "na", "n a", "none")


def strip_diacritics(c: Column) -> Column:
    return F.translate(c, PLAIN_FROM, PLAIN_TO)


@F.pandas_udf(StringType())
def _nfd_without_mn(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFD", t))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def without_marks(c: Column, all_marks: bool = False) -> Column:
    """NFD without nonspacing marks, or without any mark; ASCII texts don't go through Python."""
    made = F.regexp_replace(_nfd(c), r"\p{M}", "") if all_marks else _nfd_without_mn(c)
    return F.when(is_ascii(c), c).otherwise(made)


def replaced(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), rules, c)


def basic_key(c: Column, ascii_only: bool = False) -> Column:
    """Marks off, lower case, no honorifics, letters and digits only, single blanks. ascii_only: c is known to be ASCII."""
    low = F.lower(F.trim(c if ascii_only else without_marks(c, all_marks=True)))
    kept = F.regexp_replace(F.regexp_replace(low, rf"(?i)\b({HONORIFICS})\b", ""), r"[^a-zA-Z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def nonblank(c: Column, then: Column) -> Column:
    return F.when(F.trim(c) != "", then)


def title_key(c: Column, **how) -> Column:
    return nonblank(c, basic_key(c, **how))


def composer_key(c: Column, **how) -> Column:
    """The one spelling by which a composer's variants are known."""
    k = basic_key(c, **how)
    made = F.when(k.isin("tyagaraja", "thyagaraja", "tyagarajar", "thyagarajar"), "tyagaraja")
    made = made.when(k.isin("syama sastri", "shyama shastri", "syama sastry", "shyama shastry"), "syama sastri")
    made = made.when(k.contains("diksitar") | k.contains("dikshitar"), "muttuswami diksitar")
    return nonblank(c, made.when(k.rlike(r" sh?astr[iy]$"), F.regexp_replace(k, r" sh?astr[iy]\b", " sastri")).otherwise(k))


def raga_key(c: Column, **how) -> Column:
    return nonblank(c, replaced(basic_key(c, **how), (*LONG_VOWELS, (" ", ""))))


def tala_key(c: Column, **how) -> Column:
    k = basic_key(c, **how)
    k = F.when(k.endswith("am") & (F.length(k) > 4), F.regexp_replace(F.regexp_replace(k, "am$", "a"), "am$", "a")).otherwise(k)
    return nonblank(c, F.when(k.isin("desadi", "madyadi"), "adi").otherwise(k))


def deity_key(c: Column, **how) -> Column:
    return nonblank(c, F.nullif(F.trim(F.regexp_replace(basic_key(c, **how), r"\b(lord|goddess|sri|arulmigu)\b", "")), F.lit("")))


def temple_key(c: Column, **how) -> Column:
    return nonblank(c, F.nullif(F.trim(F.regexp_replace(basic_key(c, **how), r"\b(sri|arulmigu|tiru)\b", "")), F.lit("")))


def match_key(c: Column, kind: str = "title") -> Column:
    """The key by which records of different sources meet; kinds thin it in different ways."""
    k = F.lower(without_marks(c))
    k = F.regexp_replace(k, rf"\b({HONORIFICS})\b", " ")
    k = replaced(F.regexp_replace(k, r"[^a-z0-9\s]", " "), MATCHING_COLLAPSE)
    squeezed = F.trim(F.regexp_replace(k, r"\s+", " "))
    if kind == "composer":
        k = F.when(squeezed.isin("tyagaraja", "tyagarajar"), "tyagaraja").when(k.contains("diksitar"), "muttusvami diksitar").when(squeezed.isin("syama sastri", "syama sastry"), "syama sastri").otherwise(k)
    elif kind == "raga":
        k = replaced(k, (*LONG_VOWELS, (" ", "")))
    elif kind == "tala":
        k = F.when(squeezed.endswith("am") & (F.length(squeezed) > 4), F.regexp_replace(squeezed, "am$", "a")).otherwise(squeezed)
        k = F.when(k.isin("desadi", "madyadi"), "adi").otherwise(k)
    elif kind == "deity":
        k = F.regexp_replace(k, r"^(?:(?:lord|goddess|sri|arulmigu)\s+)+", "")
    elif kind == "temple":
        k = F.regexp_replace(k, r"^(?:(?:sri|arulmigu|tiru)\s+)+", "")
    return F.coalesce(F.trim(F.regexp_replace(k, r"\s+", " ")), F.lit(""))


def identity_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(replaced(F.regexp_replace(F.lower(without_marks(c)), r"[^a-z0-9\s]", " "), IDENTITY_COLLAPSE), r"\s+", " "))


def repaired(c: Column) -> Column:
    """Garbled diacritics put back; a dot after a capital's consonant is an abbreviation and stays."""
    out = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), GARBLED, c)
    return reduce(lambda x, r: F.regexp_replace(x, rf"(?<![A-Z]){r[0]}\.[ \t]*", r[1]), DOTTED, out)


def cleaned_name(c: Column) -> Column:
    """A name without its reference number, repaired, each word capitalised."""
    return F.initcap(F.trim(repaired(F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*", "")))))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest)


def ratio(a: Column, b: Column) -> Column:
    """Similarity in whole hundredths, cut off."""
    return (similarity(a, b) * 100).cast("int")


def position_overlap(a: Column, b: Column) -> Column:
    """Share of places at which both strings have the same character, over the longer length."""
    letters = [F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in (a, b)]
    same = F.coalesce(F.size(F.filter(F.zip_with(*letters, lambda x, y: x == y), lambda x: x)), F.lit(0))
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(same / F.greatest(F.length(a), F.length(b)))


def script_counts(c: Column) -> dict[str, Column]:
    """Letters of each script; what lies between them goes run by run, so a text without the script costs one match."""
    return {name: F.length(F.regexp_replace(c, f"[^{span}]+", "")) for name, span in SCRIPTS.items()}


def has_script(c: Column) -> Column:
    return c.rlike(f"[{''.join(SCRIPTS.values())}]")


def main_script(c: Column) -> Column:
    """The script with most characters, the first listed of equals; null without any (which ranks above a script at zero).
    Letters are counted, once for each script, only where there are others than Latin ones."""
    ranked = [F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(script_counts(c).items())]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("name"))
    others = "".join(span for name, span in SCRIPTS.items() if name != "latin")
    latin = F.when(c.rlike(f"[{SCRIPTS['latin']}]"), "latin")
    return F.when(~c.rlike(f"[{others}]"), latin).otherwise(F.array_max(F.array(*ranked, none))["name"])


def first_script(c: Column) -> Column:
    """The script of the first character that has one."""
    first = F.regexp_extract(c, f"[{''.join(SCRIPTS.values())}]", 0)
    out = F.when(first == "", None)
    for name, span in SCRIPTS.items():
        out = out.when(first.rlike(f"^[{span}]"), name)
    return out


def is_garbled(c: Column) -> Column:
    """Too short, or under half of it printable."""
    shown = F.length(F.regexp_replace(c, r"[\p{Cntrl}�]", ""))
    return (F.length(F.trim(c)) < 10) | (shown < 0.5 * F.length(c))


def pollution(c: Column) -> Column:
    """Names of the kinds of pollution in a text, in a fixed order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in POLLUTION.items()]))


def unpolluted(c: Column) -> Column:
    for kind, pattern in POLLUTION.items():
        c = F.regexp_replace(c, pattern, "\n\n" if kind == "blank_run" else "")
    return F.trim(c)


def domain(c: Column) -> Column:
    """Host of an address without www., if it has a dot."""
    host = F.substring_index(F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^www\.", ""), "/", 1)
    return F.when(host.contains("."), F.lower(host))


def language_code(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in LANGUAGE_CODES.items():
        out = F.when(F.lower(F.trim(c)) == name, code).otherwise(out)
    return out


def text_array(c: Column) -> Column:
    """An array from its text form {a,b}."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, r'^"|"$', ""))))


def page_range(c: Column) -> Column:
    """Struct of the 0-based first and last page of a range like 3-7 or 5."""
    parts = F.split(F.trim(c), r"\s*-\s*")
    first = F.try_element_at(parts, F.lit(1)).try_cast("int") - 1
    return F.struct(first.alias("first"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int") - 1, first).alias("last"))


def content_preserved(before: Column, after: Column, least: float = 0.97) -> Column:
    bare = lambda c: F.length(F.regexp_replace(c, r"[\s\d.\-–—:]+", ""))
    return bare(after) >= least * bare(before)
