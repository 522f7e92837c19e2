"""Headers of texts in six scripts: which line begins a section or a language's variant, and the variants they enclose.

A header is told by its line alone, but for the one-letter labels P, A and C in front of a line's own words: those count only in
texts that use them throughout (a gate for each text). Variants are windows over labelled lines; nothing is gathered but the
lines of one section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import demoted, merged_twins
from .structure import lines

# Latin names of sections and notes. They may stand behind bullets and brackets, in any case.
LATIN = {
    "PALLAVI": r"pallavi",
    "ANUPALLAVI": r"anupallavi",
    "CHARANAM": r"(?:ch|c)ara?n(?:\.\s*am|am)|caraṇam",
    "SAMASHTI_CHARANAM": r"samash?ti\s+(?:ch|c)ara?nam",
    "CHITTASWARAM": r"chittaswaram",
    "MADHYAMA_KALA": r"madhyama\s*kala(?:\s+sahityam)?|m\.\s*k(?:\s+sahityam)?",
    "SWARA_SAHITYA": r"svara\s+sahitya|swarasahitya",
    "MEANING": r"meaning",
    "NOTES": r"notes?",
    "GIST": r"gist",
    "WORD_DIVISION": r"word\s+division",
    "VARIATIONS": r"variations?",
}
# Names in Devanagari, Tamil, Kannada and Malayalam, and those in Telugu (which a full stop does not end).
INDIC = {
    "PALLAVI": r"पल्लवि|பல்லவி|ಪಲ್ಲವಿ|പല്ലവി",
    "ANUPALLAVI": r"अनुपल्लवि|அனுபல்லவி|ಅನುಪಲ್ಲವಿ|അനുപല്ലവി",
    "CHARANAM": r"चरण[म्ं]+|சரணம்|ಚರಣ[ಮ್ಂ]*|ചരണ[ംമ്]+",
    "SAMASHTI_CHARANAM": r"समष्टि\s+चरण[म्ं]+|ஸமஷ்டி\s+சரணம்|ಸಮಷ್ಟಿ\s+ಚರಣ[ಮ್ಂ]*|സമഷ്ടി\s+ചരണ[ംമ്]+",
    "MADHYAMA_KALA": r"[(]?मध्यम\s+काल\s+साहित्य[म्ं]*[)]?",
}
TELUGU = {"PALLAVI": r"పల్లవి", "ANUPALLAVI": r"అనుపల్లవి", "CHARANAM": r"చరణం|చరణమ్", "SAMASHTI_CHARANAM": r"సమష్టి\s+చరణ[ంమ్]+"}
SWARA = r"स्वर\s+साहित्य|ஸ்வர\s+ஸாஹித்ய|స్వర\s+సాహిత్య|ಸ್ವರ\s+ಸಾಹಿತ್ಯ|സ്വര\s+സാഹിത്യ"
# The quick passage, in brackets and alone on its line.
QUICK = r"మధ్యమ\s+కాల\s+సాహిత్య[ంమ్]+|ಮಧ್ಯಮ\s+ಕಾಲ\s+ಸಾಹಿತ್ಯ[ಂಮ್]*|മധ്യമ\s+കാല\s+സാഹിത്യ[ംമ്]+|மத்யம\s+கால\s+ஸாஹித்ய[ம்]+"
# Letters that stand for a section; the Latin ones in either case.
LETTERS = {"PALLAVI": ("p", "पபపಪപ"), "ANUPALLAVI": ("a", "अஅఅಅഅ"), "CHARANAM": ("ch?", "चசచಚച")}
# Names in square brackets, as stored texts have them.
STORED = ("PALLAVI", "ANUPALLAVI", "CHARANAM", "SAMASHTI_CHARANAM", "CHITTASWARAM", "MADHYAMA_KALA", "SWARA_SAHITYA", "SOLKATTU_SWARA")
# Headers of a language's variant, the longer before the shorter, and what a header's label means.
LANGUAGES = (
    *((f"{s} - word division", "WORD_DIVISION") for s in ("english", "devanagari", "tamil", "telugu", "kannada", "malayalam", "sanskrit")),
    *((s, s.upper()) for s in ("devanagari", "tamil", "telugu", "kannada", "malayalam", "english")),
    ("roman", "LATIN"), ("latin", "LATIN"), ("sanskrit", "SANSKRIT"), ("hindi", "HINDI"), ("word division", "WORD_DIVISION"),
    ("meaning", "MEANING"), ("gist", "GIST"), ("notes", "NOTES"), ("variations", "VARIATIONS"),
)
MEANS = {
    "SANSKRIT": ("sa", "devanagari"), "DEVANAGARI": ("sa", "devanagari"), "HINDI": ("hi", "devanagari"), "TAMIL": ("ta", "tamil"), "TELUGU": ("te", "telugu"),
    "KANNADA": ("kn", "kannada"), "MALAYALAM": ("ml", "malayalam"), "ENGLISH": ("en", "latin"), "LATIN": ("en", "latin"),
}
NOTES = ("WORD_DIVISION", "MEANING", "GIST", "NOTES", "VARIATIONS")
# Where notes begin, if no header says so.
NOTE_LINES = r"(?iu)^\s*(?:(?:meaning(?!\s+of\b)|artha|artham|भावार्थ|gist|summary|notes?(?!\s+(?:on|about|from|by|for)\b)|tippani|word\s*division|pada\s*ccheda|variations?|alternate\s*reading)\b)"

_BULLETS = r"^\s*[\-–—•*()=\[\]]*\s*"


def _patterns() -> dict[str, str]:
    """For each kind all that may begin its line."""
    made: dict[str, list[str]] = {k: [] for k in (*LATIN, "SOLKATTU_SWARA")}
    for kind, names in LATIN.items():
        made[kind].append(rf"{_BULLETS}(?:{names})(?:\b|[:.\-)\]=]|$)")
    for kind, names in INDIC.items():
        made[kind].append(rf"^\s*(?:{names})(?:[\s:\-.)\]]|$)")
    for kind, names in TELUGU.items():
        made[kind].append(rf"^\s*(?:{names})(?:[\s:\-)\]]|$)")
    made["SWARA_SAHITYA"].append(rf"^\s*(?:{SWARA})(?:[\s:\-.)\]\d]|$)")
    made["MADHYAMA_KALA"].append(rf"^\s*[(](?:{QUICK})[)]\s*$")
    made["CHARANAM"].append(r"^\s*(?-i:C)\s?\d{1,2}\s+(?=\S)")
    for kind, (latin, indic) in LETTERS.items():
        made[kind].append(rf"^\s*(?:{latin}|[{indic}])[.:\-\s]*$")
    for kind in STORED:
        made[kind].append(rf"^\s*\[{kind}\]\s*$")
    return {kind: "(?iu)" + "|".join(f"(?:{p})" for p in some) for kind, some in made.items()}


SECTIONS = _patterns()
#: Labels before a line's own words, and the sign that a text uses them.
INLINE = {kind: rf"^\s*{letter} (?=[a-zA-Z\d])" for kind, letter in (("PALLAVI", "P"), ("ANUPALLAVI", "A"), ("CHARANAM", "C"))}
INLINE_SIGN = r"(?m)^\s*C(?:\d{1,2})? (?=[a-zA-Z\d])"
INLINE_INDIC = {kind: rf"^\s*[{indic}]\d*\s*\.\s*(?=\S)" for kind, (_, indic) in LETTERS.items()}
INLINE_INDIC_SIGN = rf"(?m)^\s*[{''.join(indic for _, indic in LETTERS.values())}]\d*\s*\.\s*(?=\S)"


def _rules() -> list[tuple[str, str, str, str]]:
    """Label, pattern, what of the rest goes too, and for which texts (all, or those with labels before a line's own words)."""
    plain, numbered = r"^[:\-– ]+", r"^[:\-)\].\s]*(?:\d+\s*)?"
    languages = [(label, rf"(?iu)^{name}(?=$|:| -| –)", plain, "all") for name, label in LANGUAGES]
    inside = [(k, p, numbered, gate) for some, gate in ((SECTIONS, "all"), (INLINE, "latin"), (INLINE_INDIC, "indic")) for k, p in some.items()]
    return languages + inside


RULES = _rules()
#: Whether any rule may fit: anchored once, so that a line of prose costs one look at its beginning.
ANY = "^(?=" + "|".join(f"(?:{pattern})" for _, pattern, _, _ in RULES) + ")"


def meaning_of(label: Column) -> Column:
    """struct(language, script) of a language label; English in Latin letters for any other."""
    some = {label_: F.struct(F.lit(la).alias("language"), F.lit(sc).alias("script")) for label_, (la, sc) in MEANS.items()}
    return reduce(lambda out, x: F.when(label == x[0], x[1]).otherwise(out), some.items(), some["ENGLISH"])


def language_of_script(script: Column) -> Column:
    return reduce(lambda out, x: F.when(script == x[1], x[0]).otherwise(out), ((la, sc) for label, (la, sc) in MEANS.items() if label != "HINDI"), F.lit("en"))


def header_of(line: Column, latin: Column, indic: Column) -> Column:
    """struct(label, rest) of a line that is a header, or null. latin, indic: whether the text has labels before a line's own words.

    The rules are tried in turn, and only for lines that some rule may fit. Their patterns are literals, which a task compiles once.
    """
    gates = {"all": F.lit(True), "latin": latin, "indic": indic}
    found = F
    for label, pattern, strip, gate in RULES:
        rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, pattern, "")), strip, ""))
        found = found.when(gates[gate] & line.rlike(pattern), F.struct(F.lit(label).alias("label"), rest.alias("rest")))
    return F.when(line.rlike(ANY), found)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start, line, label (null but for headers) and rest: the line's words that belong to its section."""
    gates = docs.select("doc_id", F.col("text").rlike(INLINE_SIGN).alias("latin"), F.col("text").rlike(INLINE_INDIC_SIGN).alias("indic"))
    line = F.col("line")
    df = lines(docs.select("doc_id", "text")).where("line <> ''").join(gates, "doc_id").withColumn("head", header_of(line, F.col("latin"), F.col("indic")))
    return df.select("doc_id", "line_no", "start", "line", F.col("head.label").alias("label"), F.when(F.col("head").isNull(), line).otherwise(F.col("head.rest")).alias("rest"))


def headers(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, label and rest of the lines that are headers."""
    return labelled(docs).where("label is not null").select("doc_id", "line_no", "label", "rest")


def _upto():
    return Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _sections(df: DataFrame) -> DataFrame:
    """Sections of each variant from lines with doc_id, variant_no, language, script, block, kind and rest."""
    keys = ["doc_id", "variant_no", "language", "script"]
    made = df.where("rest <> ''").groupBy(*keys, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("line_no", "rest"))).alias("rows"))
    made = made.select(F.struct(*keys).alias("doc_id"), F.row_number().over(Window.partitionBy(*keys).orderBy("block")).alias("section_no"), "kind", F.array_join("rows.rest", "\n").alias("text"))
    made = merged_twins(demoted(made))
    return made.select("doc_id.*", F.col("section_no").cast("int").alias("section_no"), "kind", "text")


def _is(labels) -> Column:
    return F.coalesce(F.col("label").isin(*labels), F.lit(False))


def language_variants(docs: DataFrame) -> DataFrame:
    """doc_id, variant_no, language, script, section_no, kind and text of what stands under headers of a language, up to the first
    header of notes. Words of a variant before its first section are of kind OTHER."""
    df = labelled(docs).withColumn("notes", F.count_if(_is(NOTES)).over(_upto())).where("notes = 0")
    df = df.withColumn("variant_no", F.count_if(_is(MEANS)).over(_upto()).cast("int")).where("variant_no > 0")
    df = df.withColumn("of", F.last(F.when(_is(MEANS), F.col("label")), ignorenulls=True).over(_upto())).withColumn("block", F.count("label").over(_upto()))
    kind = F.last("label", ignorenulls=True).over(_upto())
    df = df.withColumn("kind", kind).withColumn("kind", F.when(F.col("kind").isin(*MEANS), "OTHER").otherwise(F.col("kind")))
    return _sections(df.withColumn("m", meaning_of(F.col("of"))).select("*", "m.language", "m.script"))


def later_variants(docs: DataFrame) -> DataFrame:
    """As language_variants(), of what stands behind the first line of notes: Indic variants only, and of scripts that none of the
    variants before has. Notes, and headers of Latin variants, end a variant."""
    note = _is(NOTES) | (F.col("label").isNull() & F.col("line").rlike(NOTE_LINES))
    df = labelled(docs).withColumn("notes", F.count_if(note).over(_upto())).where("notes > 0")
    indic = _is([k for k, (_, script) in MEANS.items() if script != "latin"])
    end = _is((*NOTES, "ENGLISH", "LATIN"))
    df = df.withColumn("of", F.last(F.when(indic, F.col("label")).when(end, ""), ignorenulls=True).over(_upto())).withColumn("variant_no", F.count_if(indic).over(_upto()).cast("int")).where("of <> ''")
    df = df.withColumn("block", F.count("label").over(_upto())).withColumn("kind", F.last("label", ignorenulls=True).over(_upto()))
    df = df.withColumn("kind", F.when(F.col("kind").isin(*MEANS), "OTHER").otherwise(F.col("kind")))
    found = _sections(df.withColumn("m", meaning_of(F.col("of"))).select("*", "m.language", "m.script"))
    return found.join(language_variants(docs).select("doc_id", "script").distinct(), ["doc_id", "script"], "left_anti").select("doc_id", "variant_no", "language", "script", "section_no", "kind", "text")


def aligned_variants(variants: DataFrame, canon: DataFrame) -> DataFrame:
    """doc_id, variant_no, section_no, kind and text: a variant's sections in the places of the canonical structure.

    variants: doc_id, variant_no, section_no, kind, text; canon: doc_id, section_no, kind. The k-th of a variant's leading OTHER
    sections takes the kind of the k-th canonical section; neighbours of one kind become one there; then the n-th of a kind
    meets the n-th of that kind, and sections without a place go. start and end, where given, are kept.
    """
    spans = [c for c in ("start", "end") if c in variants.columns]
    own = ["doc_id", "variant_no"]
    order = Window.partitionBy(*own).orderBy("section_no")
    ranked = canon.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no"))).withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("section_no")))
    df = variants.withColumn("place", F.when(F.count_if(F.col("kind") != "OTHER").over(order) == 0, F.row_number().over(order)))
    df = df.join(ranked.select("doc_id", "place", F.col("kind").alias("promoted")), ["doc_id", "place"], "left").withColumn("kind", F.coalesce("promoted", "kind"))
    change = F.coalesce(F.col("kind") != F.lag("kind").over(order), F.lit(True))
    df = df.withColumn("run", F.sum(change.cast("int")).over(order)).withColumn("many", F.count("promoted").over(Window.partitionBy(*own)))
    df = df.withColumn("part", F.when(F.col("run") <= F.col("many"), 0).otherwise(F.col("section_no")))
    rows = F.array_sort(F.collect_list(F.struct("section_no", "text")))
    joined = df.groupBy(*own, "run", "part", "kind").agg(rows.alias("rows"), *[(F.min if c == "start" else F.max)(c).alias(c) for c in spans])
    joined = joined.withColumn("occurrence", F.row_number().over(Window.partitionBy(*own, "kind").orderBy("run", "part")))
    return joined.join(ranked, ["doc_id", "kind", "occurrence"]).select(*own, "section_no", "kind", F.array_join("rows.text", "\n").alias("text"), *spans)
