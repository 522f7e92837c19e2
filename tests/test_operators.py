"""Change sets, linkage, sources, structure and streams on small tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import linkage, structure
from corpusloom.operators import tables as ops
from corpusloom.sources import html, readers
from corpusloom.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_diff_sync(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert rows(ops.diff_sync(old, new, ["k"], ["v"])) == [(1, "D", "a"), (2, "U", "c"), (3, "NOOP", None), (4, "I", "d")]


def test_upsert_keeps_old_values_behind_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, None, 2), (2, "x", None)], "k int, v string, n int")
    assert rows(ops.upsert_coalesce(old, new, ["k"])) == [(1, "a", 2), (2, "x", None)]


def test_missing_pairs_null_equals_null(spark):
    new, old = spark.createDataFrame([(1, None), (2, None)], "a int, b string"), spark.createDataFrame([(1, None)], "a int, b string")
    assert rows(ops.missing_pairs(new, old, ["a", "b"])) == [(2, None)]


def test_fuzzy_loses_nothing(spark):
    names = ["kalyani", "kalyaani", "todi", "hanumatodi", "a", "b", "ab", "zzz", "mohanam", "mohana"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.candidate) for r in linkage.fuzzy(df, df, 50).collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "name string, candidate string")
    from corpusloom.functions.text import ratio

    want = {(r.name, r.candidate) for r in pairs.where(ratio(F.col("name"), F.col("candidate")) > 50).collect()}
    assert got == want


def test_best_match_and_its_switch(spark):
    df = spark.createDataFrame([("q", 1, 95, False), ("q", 2, 93, True), ("q", 3, 80, True)], "k string, id int, score int, same_owner boolean")
    assert rows(linkage.best_match(df, "k"))[0][1] == 2
    assert rows(linkage.best_match(df, "k", strict_compat=True))[0][1] == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('KRITHI, Raga ,Hyperlink\n" Vatapi ",Hamsadhvani,http://x.org/1\n,Todi,http://x.org/2\nNo link,Todi,ftp://x.org\n')
    assert rows(readers.manifest(spark, str(tmp_path / "m.csv"))) == [("Vatapi", "Hamsadhvani", "http://x.org/1")]


def test_payload_with_bad_json(spark):
    df = spark.createDataFrame([(1, '[{"title":"a","sections":[{"type":"PALLAVI","order":1}]}]'), (2, "not json"), (3, None)], "id int, payload string")
    assert [(r.id, r.extraction.title, r.extraction.sections[0].type) for r in readers.payloads(df).collect()] == [(1, "a", "PALLAVI")]


def test_html():
    page = "<html><title>T</title><body><nav>menu</nav><div class='post-body'>One<br>Two <a href='/x'>link</a> <a href='#v'>near</a><table id='english'><tr><td>English</td></tr></table><script>x()</script></div><footer>f</footer></body></html>"
    assert html.extract(page, "http://h.org/p") == ("T", "One\nTwo link (http://h.org/x) near")
    assert html.extract(None) == (None, "")


def test_pages_are_read_in_pieces():
    rows = [(k, "http://h.org/p", f"<title>T{k}</title><body><p>One {k}" + " word" * 20_000) for k in range(60)] + [(60, None, None), (61, None, "<p>x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "html"])
    made = list(html._extracted(None)(iter([batch, batch.slice(7, 3), batch.slice(0, 0)])))
    assert max(sum(len(x) for x in m.column("text").to_pylist()) for m in made) <= html.PIECE_BYTES and len(made) > 5
    expected = [(k, *html.extract(h, u)) for k, u, h in rows]
    assert [tuple(r.values()) for m in made for r in m.to_pylist()] == expected + expected[7:10]


def test_pages_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    df = spark.range(3).selectExpr("cast(id as int) page_id", "'http://h.org/p' url", "'<p>one' html")
    assert [tuple(r) for r in html.extract_pages(df).orderBy("page_id").collect()] == [(k, None, "one") for k in range(3)]
    assert int(spark.conf.get(key)) <= html.BATCH_ROWS


def test_sections(spark):
    text = "intro\npallavi\nline one\nline two\nAnupallavi: first\ncharanam\nx\ncharanam\ny"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert rows(structure.sections(df).select("doc_id", "section_no", "kind", "occurrence", "n_lines")) == [(1, 1, "OTHER", 1, 1), (1, 2, "PALLAVI", 1, 2), (1, 3, "ANUPALLAVI", 1, 1), (1, 4, "CHARANAM", 1, 1), (1, 5, "CHARANAM", 2, 1)]


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "bad")], "id long, kind string").write.parquet(src)
    stream = lambda: spark.readStream.schema("id long, kind string").parquet(src)
    for _ in range(2):
        ingest.run(stream(), lambda df: df.withColumn("n", F.length("kind")), F.when(F.col("kind") == "bad", "bad kind"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(spark.read.parquet(str(tmp_path / "out/good")).select("id", "n")) == [(1, 1)]
    assert rows(spark.read.parquet(str(tmp_path / "out/bad")).select("id", "_error")) == [(2, '{"message":"bad kind"}')]


def test_steps_on_sections(spark):
    from corpusloom.operators import layout

    df = spark.createDataFrame([(1, 1, "PALLAVI", "a"), (1, 2, "MADHYAMA_KALA", "b"), (1, 3, "CHARANAM", "c" * 30), (1, 4, "CHARANAM", "c" * 31), (1, 5, "CHARANAM", "d")], "doc_id int, section_no int, kind string, text string")
    assert rows(layout.demoted(df))[:2] == [(1, 1, "PALLAVI", "a\nb"), (1, 2, "CHARANAM", "c" * 30)]
    assert rows(layout.merged_twins(df)) == [(1, 1, "PALLAVI", "a"), (1, 2, "MADHYAMA_KALA", "b"), (1, 3, "CHARANAM", "c" * 31), (1, 4, "CHARANAM", "d")]


def test_markers_and_boundaries(spark):
    from corpusloom.operators import layout

    df = spark.createDataFrame([(1, "Raga: Todi\npallavi\n1. Sri ragam\nViloma - Arabhi rāgaṁ\nTala - Adi")], "doc_id int, text string")
    assert rows(layout.raga_markers(df)) == [(1, 2, "Sri", False), (1, 3, "Arabhi", True)]
    assert rows(layout.boundaries(df)) == [(1, "raga", 0, 10), (1, "tala", 54, 64)]


def test_segments_of_pages(spark):
    from corpusloom.operators import layout

    blocks = [(1, 0, 0.0, 10.0, False, f"Work {i} ..... {i}") for i in range(4)] + [(1, 1, 0.0, 14.0, True, "First"), (1, 1, 1.0, 10.0, False, "body one"), (1, 2, 0.0, 10.0, False, "body two"), (1, 3, 0.0, 14.0, True, "Second"), (1, 3, 2.0, 10.0, False, "body three")]
    df = spark.createDataFrame(blocks, "doc_id int, page int, y0 double, font_size double, is_bold boolean, text string")
    assert rows(layout.segments(df)) == [(1, 1, "First", 1, "body one\nbody two"), (1, 2, "Second", 3, "body three")]


def test_detected_duplicates(spark):
    rows = [("Sri Rama", None), ("sri rama", None), ("Srirama", "x"), ("Vatapi", "x"), ("Vatapi", "y"), (None, "x"), ("Vatapi", "x"), ("Endaro", None), ("Endaro", "z")]
    found = linkage.detect_duplicates(spark.createDataFrame(rows, "title string, owner string")).collect()
    got = {(r.a, r.owner_a, r.b, r.owner_b): (r.score, r.confidence) for r in found}
    assert got.pop(("Endaro", None, "Endaro", "z")) == (100, "HIGH")
    assert got == {("Sri Rama", None, "sri rama", None): (100, "HIGH"), ("Sri Rama", None, "Srirama", "x"): (100, "HIGH"), ("Srirama", "x", "sri rama", None): (100, "HIGH"), ("Vatapi", "x", "Vatapi", "y"): (100, "HIGH")}


def test_import_match_takes_the_highest_score(spark):
    pairs = spark.createDataFrame([("a", 1, 80, True), ("a", 2, 91, False), ("b", 1, 90, False), ("c", 3, 76, True), ("c", 2, 76, True)], "name string, id int, score int, same_owner boolean")
    assert sorted(tuple(r) for r in linkage.import_match(pairs, "name").select("name", "id").collect()) == [("a", 2), ("c", 2)]


def test_headers_of_every_script(spark):
    from corpusloom.operators import headers

    cases = {
        "• Pallavi -": "PALLAVI", "ANUPALLAVI": "ANUPALLAVI", "charan. am 2": "CHARANAM", "caraṇam": "CHARANAM", "Samasti Caranam": "SAMASHTI_CHARANAM", "(madhyama kAla sAhityam)": "MADHYAMA_KALA", "m.k": "MADHYAMA_KALA",
        "svara sAhitya 3": "SWARA_SAHITYA", "ஸ்வர ஸாஹித்ய 2": "SWARA_SAHITYA", "C12 rAjillu": "CHARANAM", "c12 rAjillu": None, "P": "PALLAVI", "a.": "ANUPALLAVI", "Ch :": "CHARANAM", "ப": "PALLAVI", "ப 4 ரதாக்": None,
        "चरणम्": "CHARANAM", "समष्टि चरणम्": "SAMASHTI_CHARANAM", "చరణం": "CHARANAM", "చరణమ్ x": "CHARANAM", "ಚರಣ": "CHARANAM", "ചരണം": "CHARANAM", "ஸமஷ்டி சரணம்": "SAMASHTI_CHARANAM", "(ಮಧ್ಯಮ ಕಾಲ ಸಾಹಿತ್ಯಂ)": "MADHYAMA_KALA",
        "ಮಧ್ಯಮ ಕಾಲ ಸಾಹಿತ್ಯಂ": None, "[SOLKATTU_SWARA]": "SOLKATTU_SWARA", "Word Division": "WORD_DIVISION", "Tamil - Word Division": "WORD_DIVISION", "Kannada –": "KANNADA", "roman: x": "LATIN", "Tamil poets": None, "pallavis": None, "gist": "GIST", "Notes on it": "NOTES", "A jagadamba": None,
    }
    df = spark.createDataFrame([(i, line) for i, line in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.label for r in headers.labelled(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_blocking_loses_no_pair_and_prunes(spark):
    import random

    pick = random.Random(3)
    names = {"".join(pick.choices("abcdefghijklmnopqrstuvwxyz ", k=pick.randint(4, 40))).strip() for _ in range(150)}
    for n in list(names)[:60]:
        i = pick.randrange(len(n))
        names.add(n[:i] + pick.choice("abc") + n[i + 1 :])
        names.add(n[:i] + n[i + 1 :])
    left, right = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in ("name", "candidate"))
    every = left.join(right, F.length("name") > -F.length("candidate")).select("name", "candidate", tx.ratio(F.col("name"), F.col("candidate")).alias("score"))
    for least, share in ((60, 0.8), (80, 0.4), (90, 0.2)):
        want = {(r.name, r.candidate) for r in every.where(F.col("score") > least).collect()}
        found = {(r.name, r.candidate) for r in linkage.candidates(left, right, least).collect()}
        assert want <= found and len(found) < share * len(names) ** 2


def test_few_pairs_of_common_letters_are_candidates(spark):
    import random

    pick = random.Random(5)
    word = lambda: "".join(pick.choices("etaoinsrhldu", k=pick.randint(4, 8)))
    names = sorted({f"{word()} {word()}" for _ in range(4000)})
    left, right = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in ("name", "candidate"))
    for least, share in ((75, 0.002), (90, 0.0005)):
        assert linkage.candidates(left, right, least).distinct().count() < share * len(names) ** 2


def test_split_keys_lose_no_pair(spark):
    names = [f"gopala {i % 40:02d}{'xyz'[i % 3]}" for i in range(120)] + ["g" * 150 + c for c in "abc"] + ["", "a", "b", "é"]
    left, right = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in ("name", "candidate"))
    some = {(r.name, r.candidate) for r in linkage.candidates(left, right, 70, heavy=7).collect()}
    assert some == {(r.name, r.candidate) for r in linkage.candidates(left, right, 70).collect()}
    every = left.join(right, F.length("name") > -F.length("candidate") - 1).where(tx.ratio(F.col("name"), F.col("candidate")) > 70)
    assert {(r.name, r.candidate) for r in every.select("name", "candidate").collect()} <= some | {("", "")}


def test_snapshot_and_pairs_join_nothing(spark, tmp_path):
    """Sorting the lines for joins took a task's memory in step with the table; doubled and null keys count as in the SQL."""
    import duckdb

    from corpusloom.plans.registry import QUERIES, SQL

    spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, "A", "O", 1), (1, "N", "F", 2), (1, None, "O", 3), (2, "A", "O", 1), (2, "A", "O", None), (9, "R", None, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_linestatus string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for name in ("orders", "lineitem"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("q_snapshot", "join_cross_filtered"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, duck.execute(SQL[name]).fetchall()))
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_starts_are_cut_before_the_window(spark):
    """Whole texts don't go through the windows, and pairs are compared in tasks of their own; the scores are as they were."""
    from pyspark.sql import Window

    from corpusloom.functions import matching
    from corpusloom.plans.registry import QUERIES

    df = QUERIES["fn_lev_ratio_500"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("Window") and "regexp_replace" not in plan[: plan.index("Window")]
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lag("doc_id").over(w).alias("before"), F.lag("text").over(w).alias("other")).where("before is not null")
    want = docs.select("doc_id", "before", matching.ratio_of_starts(F.col("text"), F.col("other")).alias("score"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
