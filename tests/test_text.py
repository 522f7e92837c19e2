"""Functions on names: pinned keys, and what must hold of any string."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("s"))).collect()]


def test_match_keys(spark):
    assert values(spark, ["Muthuswami Dikshitar", "Tyāgarāja"], lambda c: tx.match_key(c, "composer")) == ["muttusvami diksitar", "tyagaraja"]
    assert values(spark, ["Rupakam", "Desadi", "Adi"], lambda c: tx.match_key(c, "tala")) == ["rupaka", "adi", "adi"]
    assert values(spark, ["Akhilaandeshwari"], lambda c: tx.match_key(c, "raga")) == ["akilandeswari"]
    assert values(spark, ["Muthuswami Dikshitar"], tx.identity_key) == ["mutuswami diksitar"]


def test_name_keys(spark):
    assert values(spark, ["Sri Shyama Shastri", "Dikshitar", " ", None], tx.composer_key) == ["syama sastri", "muttuswami diksitar", None, None]
    assert values(spark, ["Kedara Gaula", "Kalyaani"], tx.raga_key) == ["kedaragaula", "kalyani"]
    assert values(spark, ["Lord Shiva", "sri"], tx.deity_key) == ["shiva", None]


def test_diacritics(spark):
    assert values(spark, ["rāgaṃ Ṣaḍja", None], tx.strip_diacritics) == ["ragam Sadja", None]
    assert values(spark, ["r¯aga ˙m", "mi´sra", "Dr. x", "n. d. e", "t¯al.a"], tx.repaired) == ["rāgaṁ", "miśra", "Dr. x", "ṇḍe", "tāḷa"]
    assert values(spark, ["śaṅkarābharaṇaṃ (29)"], tx.cleaned_name) == ["Śaṅkarābharaṇaṃ"]


def test_scripts_and_pollution(spark):
    assert values(spark, ["abc पल्लवि पल्लवि", "123", "தமிழ் a"], tx.main_script) == ["devanagari", None, "tamil"]
    assert values(spark, ["1 தமிழ் abc"], tx.first_script) == ["tamil"]
    text = "line\nSource: somewhere\nhttp://x.org/a\n\n\n\nPage 3\nrest"
    assert values(spark, [text], tx.pollution) == [["url", "attribution", "page_number", "blank_run"]]
    assert "http" not in values(spark, [text], tx.unpolluted)[0]


def test_page_range_and_arrays(spark):
    assert [tuple(r) for r in values(spark, ["3-7", "5"], tx.page_range)] == [(2, 6), (4, 4)]
    assert values(spark, ["{a,b}", "{}"], tx.text_array) == [["a", "b"], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=8), st.text("abc ", max_size=8)), min_size=1, max_size=20))
def test_ratio_is_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", tx.ratio(F.col("a"), F.col("b")).alias("x"), tx.ratio(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 100 and (r.x == 100) == (r.a == r.b)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("aé中😀", max_size=12), min_size=1, max_size=30))
def test_cut_to_bytes(spark, texts):
    from corpusloom.functions.matching import cut_to_bytes

    want = [t.encode()[:7].decode(errors="ignore") for t in texts]
    assert values(spark, texts, lambda c: cut_to_bytes(c, 7)) == want


def test_main_script_counts_each_script_once(spark):
    from corpusloom.operators import structure

    assert values(spark, ["abc தமி x", "a த", "पक अத 12", None, "", "é-ß"], tx.main_script) == ["latin", "tamil", "devanagari", None, None, "latin"]
    docs = spark.createDataFrame([(1, "a\nb\nத\n1")], "doc_id int, text string")
    for df in (docs.select(tx.main_script(F.col("text"))), structure.by_script(docs).drop("text")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= 2 * len(tx.SCRIPTS) + 1 and "collect_list" not in plan
    assert sorted(tuple(r) for r in structure.by_script(docs).collect()) == [(1, "latin", 2, "a\nb"), (1, "tamil", 1, "த")]
