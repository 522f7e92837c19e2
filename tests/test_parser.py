"""Whole structures of texts, one case for each form that sources have."""

import itertools

import duckdb
import pytest

from corpusloom.operators import parser
from corpusloom.plans import works
from corpusloom.plans.base import Tables

P, A, C = "PALLAVI", "ANUPALLAVI", "CHARANAM"
#: Name, text, then kinds of sections, scripts and languages of variants, and labels of boundaries.
CASES = {
    "language headers": ("English\nPallavi\nmadhura gItam\n\nAnupallavi\nsarasa vAkyam\n\nCharanam\nsundara rUpam\n\nDevanagari\nपल्लवि\nमधुर गीतम्\n\nअनुपल्लवि\nसरस वाक्यम्\n\nचरणम्\nसुन्दर रूपम्\n\nMeaning\nsome prose here.\n", [P, A, C], ["latin", "devanagari"], ["en", "sa"], ["MEANING"]),
    "one script": ("பல்லவி\nமதுர கீதம்\n\nஅனுபல்லவி\nஸரஸ வாக்யம்\n\nசரணம்\nஸுந்தர ரூபம்\n", [P, A, C], ["tamil"], ["ta"], []),
    "variants behind notes": (
        "pallavi\nmadhura gItam\n\nanupallavi\nsarasa vAkyam\n\n(madhyama kAla sAhityam)\nvega gItam\n\ncharanam\nsundara rUpam\n" + "gAnam pAnam\n" * 16 + "\nvariations\nmadhura - madura\n\nMeaning\nprose\n\nDevanagari\nपल्लवि\nमधुर गीतम्\n\nचरणम्\nसुन्दर रूपम्\n\n"
        "Devanagari - Word Division\nपल्लवि\nम धु र\n\nBack\n\nTamil\nபல்லவி\nமதுர கீதம்\n\nvariations\nmadhura - madura\n\nTelugu\nపల్లవి\nమధుర గీతమ్\n",
        [P, A, C], ["latin", "devanagari", "tamil", "telugu"], ["en", "sa", "ta", "te"], ["VARIATIONS", "MEANING", "VARIATIONS"],
    ),
    "numbered": ("pallavi\nmadhura gItam\n\nanupallavi\nsarasa vAkyam\n\ncaraNam 1\nsundara rUpam\n\ncaraNam 2\nkomala pAdam\n\ncaraNam 3\nnirmala hRdayam\n\nGist\nprose.\n\nTelugu\nపల్లవి\nమధుర గీతమ్\n\nచరణమ్\nసుందర రూపమ్\n", [P, A, C, C, C], ["latin", "telugu"], ["en", "te"], ["GIST"]),
    "letters": ("P\nmadhura gItam\n\nA\nsarasa vAkyam\n\nC\nsundara rUpam\n\nGist\nprose.\n\nNotes\nmore prose.\n\nKannada\nಪ.\nಮಧುರ ಗೀತಮ್\n\nಅ.\nಸರಸ ವಾಕ್ಯಮ್\n\nಚ.\nಸುಂದರ ರೂಪಮ್\n", [P, A, C], ["latin", "kannada"], ["en", "kn"], ["GIST", "NOTES"]),
    "ragas within sections": ("pallavi\n1. SrI rAgaM\nmadhura gItam\n2. Arabhi rAgaM\nkomala gItam\n\nanupallavi\n3. gauri rAgaM\nsarasa vAkyam\n\ncharanam\n4. nATa rAgaM\nsundara rUpam\n\nDevanagari\nमधुर गीतम् - आदि\n\nपल्लवि\n1. श्री रागं\nमधुर गीतम्\n\nअनुपल्लवि\nसरस वाक्यम्\n\nTamil\nபல்லவி\nமதுர கீதம்\n", [P, A, C], ["devanagari", "tamil"], ["sa", "ta"], []),
    "first section without a header": ("pallavi\nmadhura gItam\n\nanupallavi\nsarasa vAkyam\n\ncharanam\nsundara rUpam\n\nDevanagari\nमधुर गीतम्\n\nअनुपल्लवि\nसरस वाक्यम्\n\nचरणम्\nसुन्दर रूपम्\n", [P, A, C], ["devanagari"], ["sa"], []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    extra = {"plain": "just words\nof a text", "blank": " \n ", "null": None, "only quick": "m.k\nvega gItam", "early link": "Meaning\npallavi\n" + "madhura gItam\n" * 60 + "Notes\nx"}
    docs = {**{k: v[0] for k, v in CASES.items()}, **extra}
    df = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    return docs, {r.doc_id: r for r in parser.parse(df).collect()}


@pytest.mark.parametrize("case", CASES)
def test_structures(parsed, case):
    row, (_, kinds, scripts, languages, labels) = parsed[1][case], CASES[case]
    assert [s.kind for s in row.sections] == kinds
    assert [v.script for v in row.variants] == scripts
    assert [v.language for v in row.variants] == languages
    assert [b.label for b in row.boundaries] == labels
    assert all("prose" not in s.text for part in (row.sections, *(v.sections for v in row.variants)) for s in part)


def test_places_are_those_of_the_text(parsed):
    for case, row in parsed[1].items():
        text = parsed[0][case]
        for b in row.boundaries:
            assert text[b.start : b.end].lower().replace(" ", "_") == b.label.lower()
        for s in (*row.sections, *(s for v in row.variants if len(row.variants) > 1 for s in v.sections)):
            assert text[s.start : s.end] == text[s.start : s.end].strip()
            got = [x.strip() for x in s.text.split("\n") if x.strip() and x != parser.QUICK_MARK]
            span = [x.strip() for x in text[s.start : s.end].split("\n") if x.strip()]
            assert set(got) <= set(span) and span[0] == got[0] and span[-1] == got[-1]


def test_leading_words_take_the_first_place(parsed):
    first = parsed[1]["first section without a header"].variants[0].sections
    assert [(s.section_no, s.kind) for s in first] == [(1, P), (2, A), (3, C)] and first[0].text == "मधुर गीतम्"
    ragas = parsed[1]["ragas within sections"].variants[0].sections
    assert ragas[0].text == "मधुर गीतम् - आदि\n1. श्री रागं\nमधुर गीतम्"


def test_quick_passage_ends_its_section(parsed):
    assert parsed[1]["variants behind notes"].sections[1].text == f"sarasa vAkyam\n\n{parser.QUICK_MARK}\nvega gItam"
    assert parsed[1]["only quick"].sections == []


def test_texts_without_structure(parsed):
    assert [tuple(s) for s in parsed[1]["plain"].sections] == [(1, "OTHER", "just words\nof a text", 0, 20)]
    assert [v.script for v in parsed[1]["plain"].variants] == ["latin"]
    for case in ("blank", "null"):
        assert parsed[1][case].sections == parsed[1][case].variants == parsed[1][case].boundaries == []


def test_early_link_is_no_end(parsed):
    row = parsed[1]["early link"]
    assert [b.label for b in row.boundaries] == ["MEANING", "NOTES"] and [s.kind for s in row.sections] == [P]
    assert row.sections[0].text == "\n".join(["madhura gItam"] * 60)


def test_prose_behind_sung_lines_is_cut(spark):
    text = "pallavi\nmadhura\n\ncharanam\nsundara\n\nTamil\nபல்லவி\nமது4ர\n\nசரணம்\nஸுந்த3ர\nஇது ஒரு நீண்ட உரை விளக்கம்\nமேலும் ஒரு நீண்ட உரை விளக்கம்"
    row = parser.parse(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [s.text for s in row.variants[0].sections] == ["மது4ர", "ஸுந்த3ர"]


def test_whole_texts_stay_below_the_lines(spark):
    """What a text's signs cost must not be paid for each of its lines."""
    df = spark.createDataFrame([(1, "P\nC one")], "doc_id int, text string")
    plan = parser.read_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "(?m)" not in above and below.count("(?m)") == 2
    assert "text#" not in above


#: Lines at which plain headers and the composed parser part, or ASCII and Unicode.
ODD = ("Tamil", "English", "Meaning", "meaning", "P", "A.", "c:-", "Ch", "charanam 12", "சரணம் 3", "பல்லவி", "Anupallavi\t", "pallavi\u00a0", "\u00a0Pallavi", "pallavi\x0b", "p\u2028", "back\u0085", "BacK", "poſted by me",
       "copyr\u0131ght", "a i i u u", "(one - two)", "(one -\u00a0two)", "one\\nP\\ntwo", "x\u2082y", "Gist", "Notes", "Devanagari", "C one", "[PALLAVI]", "अनुपल्लवि", "charanam ١", "words of prose", "\r", "  words\r")


def test_documents_equal_their_sql_on_odd_lines(spark, tmp_path):
    texts = [None, "", "\n \n", *ODD, *("\n".join(x) for x in itertools.product(ODD, repeat=2)), *("\n".join((x, "one", y, "P", "two", y)) for x, y in itertools.product(ODD, ODD[:12]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, n_sections, kind, content"
    want = con.execute(f"select {names} from ({works._DOCUMENTS}) order by doc_id").fetchall()
    got = [tuple(r) for r in works.parse_documents(Tables(spark, str(tmp_path))).select(*names.split(", ")).orderBy("doc_id").collect()]
    assert [(texts[g[0]], g, w) for g, w in zip(got, want, strict=True) if g != w] == []
