"""Functions on names and texts over literal fixtures with diacritics and Indic letters, which the driver's tables lack; the SQL says
what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions import text as tx
from .base import Tables, query
from .sections import values

NAMES = (
    (1, "Muttusvāmi Dīkṣitar"), (2, "Śyāmā Śāstri"), (3, "Thyagaraja"), (4, "Kedāra Gaula"), (5, "Kalyaani"), (6, "Rūpakam"), (7, "Deśādi"),
    (8, "Lord Śiva"), (9, "Sri Kāmākṣi"), (10, "Tiru Ārūr"), (11, "śaṅkarābharaṇaṃ (29)"), (12, "वातापि"), (13, "தமிழ் a"), (14, "  "), (15, None),
)


def names(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(NAMES, "id int, name string")


@query(
    values(
        "id, plain, bare, basic, identity, cleaned",
        (1, "Muttusvami Diksitar", "Muttusvami Diksitar", "muttusvami diksitar", "muttusvami diksitar", "Muttusvāmi Dīkṣitar"),
        (2, "Syama Sastri", "Syama Sastri", "syama sastri", "syama sastri", "Śyāmā Śāstri"),
        (3, "Thyagaraja", "Thyagaraja", "thyagaraja", "tyagaraja", "Thyagaraja"),
        (4, "Kedara Gaula", "Kedara Gaula", "kedara gaula", "kedara gaula", "Kedāra Gaula"),
        (5, "Kalyaani", "Kalyaani", "kalyaani", "kalyani", "Kalyaani"),
        (6, "Rupakam", "Rupakam", "rupakam", "rupakam", "Rūpakam"),
        (7, "Desadi", "Desadi", "desadi", "desadi", "Deśādi"),
        (8, "Lord Siva", "Lord Siva", "lord siva", "lord siva", "Lord Śiva"),
        (9, "Sri Kamaksi", "Sri Kamaksi", "kamaksi", "sri kamaksi", "Sri Kāmākṣi"),
        (10, "Tiru Arur", "Tiru Arur", "tiru arur", "tiru arur", "Tiru Ārūr"),
        (11, "sankarabharanam (29)", "sankarabharanam (29)", "sankarabharanam 29", "sankarabaranam 29", "Śaṅkarābharaṇaṃ"),
        (12, "वातापि", "वातापि", "", "", "वातापि"),
        (13, "தமிழ் a", "தமிழ a", "a", "a", "தமிழ் A"),
        (14, "  ", "  ", "", "", ""),
        (15, None, None, None, None, None),
    )
)
def fn_plain_letters_fixture(t: Tables) -> DataFrame:
    c = F.col("name")
    return names(t).select("id", tx.strip_diacritics(c).alias("plain"), tx.without_marks(c).alias("bare"), tx.basic_key(c).alias("basic"), tx.identity_key(c).alias("identity"), tx.cleaned_name(c).alias("cleaned"))


@query(
    values(
        "id, title, composer, raga, tala, deity, temple",
        (1, "muttusvami diksitar", "muttuswami diksitar", "muttusvamidiksitar", "muttusvami diksitar", "muttusvami diksitar", "muttusvami diksitar"),
        (2, "syama sastri", "syama sastri", "syamasastri", "syama sastri", "syama sastri", "syama sastri"),
        (3, "thyagaraja", "tyagaraja", "thyagaraja", "thyagaraja", "thyagaraja", "thyagaraja"),
        (4, "kedara gaula", "kedara gaula", "kedaragaula", "kedara gaula", "kedara gaula", "kedara gaula"),
        (5, "kalyaani", "kalyaani", "kalyani", "kalyaani", "kalyaani", "kalyaani"),
        (6, "rupakam", "rupakam", "rupakam", "rupaka", "rupakam", "rupakam"),
        (7, "desadi", "desadi", "desadi", "adi", "desadi", "desadi"),
        (8, "lord siva", "lord siva", "lordsiva", "lord siva", "siva", "lord siva"),
        (9, "kamaksi", "kamaksi", "kamaksi", "kamaksi", "kamaksi", "kamaksi"),
        (10, "tiru arur", "tiru arur", "tiruarur", "tiru arur", "tiru arur", "arur"),
        (11, "sankarabharanam 29", "sankarabharanam 29", "sankarabharanam29", "sankarabharanam 29", "sankarabharanam 29", "sankarabharanam 29"),
        (12, "", "", "", "", None, None),
        (13, "a", "a", "a", "a", "a", "a"),
        (14, None, None, None, None, None, None),
        (15, None, None, None, None, None, None),
    )
)
def fn_name_keys_fixture(t: Tables) -> DataFrame:
    c = F.col("name")
    return names(t).select("id", tx.title_key(c).alias("title"), tx.composer_key(c).alias("composer"), tx.raga_key(c).alias("raga"), tx.tala_key(c).alias("tala"), tx.deity_key(c).alias("deity"), tx.temple_key(c).alias("temple"))


@query(
    values(
        "id, title, composer, raga, tala, deity, temple",
        (1, "muttusvami diksitar", "muttusvami diksitar", "muttusvamidiksitar", "muttusvami diksitar", "muttusvami diksitar", "muttusvami diksitar"),
        (2, "syama sastri", "syama sastri", "syamasastri", "syama sastri", "syama sastri", "syama sastri"),
        (3, "tyagaraja", "tyagaraja", "tyagaraja", "tyagaraja", "tyagaraja", "tyagaraja"),
        (4, "kedara gaula", "kedara gaula", "kedaragaula", "kedara gaula", "kedara gaula", "kedara gaula"),
        (5, "kalyaani", "kalyaani", "kalyani", "kalyaani", "kalyaani", "kalyaani"),
        (6, "rupakam", "rupakam", "rupakam", "rupaka", "rupakam", "rupakam"),
        (7, "desadi", "desadi", "desadi", "adi", "desadi", "desadi"),
        (8, "lord siva", "lord siva", "lordsiva", "lord siva", "siva", "lord siva"),
        (9, "kamaksi", "kamaksi", "kamaksi", "kamaksi", "kamaksi", "kamaksi"),
        (10, "tiru arur", "tiru arur", "tiruarur", "tiru arur", "tiru arur", "arur"),
        (11, "sankarabaranam 29", "sankarabaranam 29", "sankarabaranam29", "sankarabaranam 29", "sankarabaranam 29", "sankarabaranam 29"),
        (12, "", "", "", "", "", ""),
        (13, "a", "a", "a", "a", "a", "a"),
        (14, "", "", "", "", "", ""),
        (15, "", "", "", "", "", ""),
    )
)
def fn_match_keys_fixture(t: Tables) -> DataFrame:
    return names(t).select("id", *[tx.match_key(F.col("name"), k).alias(k) for k in ("title", "composer", "raga", "tala", "deity", "temple")])


TEXTS = (
    (1, "abc पल्लवि पल्लवि"), (2, "1 தமிழ் abc"), (3, "123 --"), (4, "\x01\x01\x02\x03\x04\x05\x06\x07abcd"), (5, "short"), (6, "r¯aga ˙m and mi´sra c¯apu, Dr. x n. d. e"),
    (7, "line\nSource: somewhere\nhttp://x.org/a\n\n\n\nPage 3\nrest"), (8, "© 2001 A\nMeaning: none\nCredit - me\nkept"), (9, "తెలుగు ಕನ್ನಡ"), (10, "മലയാളം abc def"), (11, None),
)


@query(
    values(
        "id, script, first, garbled, repaired, pollution, cleaned",
        (1, "devanagari", "latin", False, "abc पल्लवि पल्लवि", [], "abc पल्लवि पल्लवि"),
        (2, "tamil", "tamil", False, "1 தமிழ் abc", [], "1 தமிழ் abc"),
        (3, None, None, True, "123 --", [], "123 --"),
        (4, "latin", "latin", True, '\x01\x01\x02\x03\x04\x05\x06\x07abcd', [], '\x01\x01\x02\x03\x04\x05\x06\x07abcd'),
        (5, "latin", "latin", True, "short", [], "short"),
        (6, "latin", "latin", False, "rāgaṁ and miśra cāpu, Dr. x ṇḍe", [], "r¯aga ˙m and mi´sra c¯apu, Dr. x n. d. e"),
        (7, "latin", "latin", False, "line\nSource: somewhere\nhttp://x.org/a\n\n\n\nPage 3\nrest", ['url', 'attribution', 'page_number', 'blank_run'], "line\n\nrest"),
        (8, "latin", "latin", False, "© 2001 A\nMeaning: none\nCredit - me\nkept", ['attribution', 'meaning', 'copyright'], "\n\nkept"),
        (9, "telugu", "telugu", False, "తెలుగు ಕನ್ನಡ", [], "తెలుగు ಕನ್ನಡ"),
        (10, "malayalam", "malayalam", False, "മലയാളം abc def", [], "മലയാളം abc def"),
        (11, None, None, None, None, [], None),
    )
)
def fn_texts_fixture(t: Tables) -> DataFrame:
    c = F.col("text")
    df = t.spark.createDataFrame(TEXTS, "id int, text string")
    return df.select("id", tx.main_script(c).alias("script"), tx.first_script(c).alias("first"), tx.is_garbled(c).alias("garbled"), tx.repaired(c).alias("repaired"), tx.pollution(c).alias("pollution"), tx.unpolluted(c).alias("cleaned"))


PAIRS = ((1, "kitten", "sitting"), (2, "vatapi ganapatim", "vatapi  ganapatim bhaje"), (3, "", ""), (4, "abc", None), (5, "é中a", "é中b"), (6, "aXbXc", "abc"))


@query(
    values(
        "id, ratio, blocks, run, starts, overlap, start",
        (1, 57, 61.538, 3, 57, 0.571, "kitt"),
        (2, 69, 82.051, 15, 72, 0.304, "vata"),
        (3, 100, 100.0, 0, 100, 1.0, ""),
        (4, None, None, 0, None, 0.0, "abc"),
        (5, 66, 66.667, 2, 66, 0.667, "é"),
        (6, 60, 75.0, 1, 60, 0.2, "aXbX"),
    )
)
def fn_pairs_fixture(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame(PAIRS, "id int, a string, b string")
    a, b = F.col("a"), F.col("b")
    return df.select("id", tx.ratio(a, b).alias("ratio"), F.round(matching.sequence_ratio(a, b), 3).alias("blocks"), matching.longest_shared_run(a, b).alias("run"), matching.ratio_of_starts(a, b).alias("starts"), F.round(tx.position_overlap(a, b), 3).alias("overlap"), matching.cut_to_bytes(a, 4).alias("start"))
