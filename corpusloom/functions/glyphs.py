"""Text set in a Devanagari font of its own coding, to Unicode: glyphs, then vowel signs, then vowels. All as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The font's coding, by code. Vowels and their signs, consonants, half forms (a consonant and the sign that takes
# its vowel away), ligatures (consonants joined by that sign) and marks.
SIGNS = {97: "अ", 105: "इ", 117: "उ", 101: "ए", 65: "ा", 69: "ि", 70: "ी", 0: "ु", 1: "ू", 3: "े", 111: "ो", 123: "ै", 79: "ौ", 2: "ृ", 92: "ं", 94: "्", 44: "ः"}
CONSONANTS = dict(zip(b"kKgGcCjJVWXYZtTdDnpPbBmyrl\x0fvfqsh", "कखगघचछजझटठडढणतथदधनपफबभमयरलळवशषसह", strict=True))
HALVES = {4: "र", 5: "य", 6: "न", 7: "ल", 8: "त", 9: "द", 10: "क", 11: "ग", 12: "प", 13: "र", 14: "ब", 16: "व", 17: "च", 18: "ज", 19: "स", 20: "ह", 21: "ष", 22: "न", 23: "ण", 77: "म", 91: "श"}
LIGATURES = {
    34: "कष", 129: "तत", 130: "दद", 131: "दध", 132: "दव", 133: "दय", 134: "हन", 135: "हम", 136: "हय", 137: "हर", 138: "हल", 139: "हव",
    152: "शव", 153: "शर", 163: "षट", 164: "तर", 165: "लल", 166: "नन", 167: "नद", 168: "नध", 226: "जञ",
}
VOWELS = {"अा": "आ", "इी": "ई", "उू": "ऊ"}
VIRAMA, LEFT = "्", "ि"


def glyphs() -> dict[str, str]:
    made = {**SIGNS, **CONSONANTS, **{k: c + VIRAMA for k, c in HALVES.items()}, **{k: VIRAMA.join(pair) for k, pair in LIGATURES.items()}}
    return {chr(code): text for code, text in made.items()}


def decoded(c: Column) -> Column:
    """The text in Unicode. The sign that is set left of its consonants goes behind their cluster; other characters stay."""
    table = F.create_map(*map(F.lit, chain.from_iterable(glyphs().items())))
    plain = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    consonant = "[क-ह]"
    out = F.regexp_replace(plain, f"{LEFT}((?:{consonant}{VIRAMA})+{consonant}?|{consonant})", f"$1{LEFT}")
    for apart, one in VOWELS.items():
        out = F.replace(out, F.lit(apart), F.lit(one))
    return out
