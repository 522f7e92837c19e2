"""Packing, decontamination, chat formatting, URL filters and the pipeline."""

import hashlib
import re
import zlib

import brute
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusloom.llm import chat, decontaminate, langid, packing, registry, url_filter

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(registry.SQL[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


# --- packing


def test_tokens_equal_the_tokenizers_own(spark, docs):
    enc = packing.encoder(packing.vocabulary_path())
    texts = [t for _, t in ROWS if t] + ["a<|endoftext|>b <|startoftext|>", "x\x01y \x01 z", "a\u00a0b\u3000c", "İstanbul ΣΑΣ ﬁ", "don't we'll 12 345", "e\u0301 \u0301x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.token_pieces(df, packing.vocabulary_path()).orderBy("doc_id", "piece").collect():
        assert r.start == 4 * 1024 * r.piece and r.length == len(r.ids) // 4 <= packing.CAPACITY
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], np.uint32).tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_packing_cases(spark, docs, repeated, empty, unnamed):
    for df, n in ((docs, len(ROWS)), (repeated, repeated.count()), (unnamed, 3)):
        rows = packing.packed_documents(df).collect()
        assert len({(r.doc_id, r.piece) for r in rows}) <= len(rows) >= n
        check_places(rows)
    assert packing.packed_documents(empty).collect() == []
    none = next(r for r in packing.packed_documents(docs).collect() if r.doc_id == 5)
    assert (none.length, none.ids_crc32) == (1, zlib.crc32(np.array([1], np.uint32).tobytes()))


def test_packing_on_the_table(spark):
    """The program reaches the bound, nearly all sequences come from rounding it, and plain best fit is no better."""
    rows = packing.op3_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    counts = np.bincount([r.length for r in rows], minlength=packing.CAPACITY + 1)
    bound = sum(r.length for r in rows) / packing.CAPACITY
    plain = sum(n for _, n in packing.best_fit(counts.copy(), [], packing.CAPACITY))
    assert -(-bound // 1) <= check_places(rows) <= plain
    coarse = np.bincount(-(-np.arange(len(counts)) // packing.GRAIN), weights=counts)
    assert bound <= sum(packing.solve(coarse, packing.CAPACITY // packing.GRAIN).values()) <= 1.005 * bound
    assert sum(n for _, n in packing.rounded(counts)[0]) > 0.9 * plain


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(1, 50))
def test_the_programs_solution_covers_each_length(lengths, times):
    counts = np.bincount(lengths, minlength=65) * times
    covered = np.zeros(65)
    for config, amount in packing.solve(counts, 64).items():
        assert sum(x * n for x, n in config) <= 64 and amount > 0
        for x, n in config:
            covered[x] += n * amount
    assert np.allclose(covered, counts)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.integers(1, 500))
def test_plan_uses_every_piece_once(lengths, times):
    counts = np.bincount(lengths, minlength=65) * times
    plan = packing.pack_plan(counts, 64, 2)
    used = np.zeros(65, np.int64)
    for some, many in plan:
        assert sum(some) <= 64 and many > 0
        for x in some:
            used[x] += many
    assert (used == counts).all()
    plain = sum(n for _, n in packing.best_fit(counts.copy(), [], 64))
    assert sum(n for _, n in plan) <= 1.15 * plain + 2


# --- decontamination

ITEMS = [("b1", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), ("b2", "short item"), ("b3", None), ("b4", "..."), ("b5", "SHORT, item!")]


def hits(text, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        b = words(t)
        for i in range(max(1, len(b) - width + 1)) if b else ():
            p = b[i : i + width]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(name)
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("size", [1 << 24, 200])
def test_contamination(spark, size):
    texts = [t for _, t in ROWS] + ["x " + ITEMS[0][1].upper() + " y", "été-" + ITEMS[0][1][:80] + "; short -- ITEM.", "shorts items short item short item", " ".join(f"w{i}" for i in range(300)) + " short item"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.find_passages(df, items, pattern_bytes=size)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.mapInArrow(decontaminate._digest, decontaminate.DIGEST).collect()}
    assert got == {i: hits(t, ITEMS) for i, t in enumerate(texts)}
    for r in found.collect():
        for h in r.hits:
            assert decontaminate.words_of(texts[r.doc_id][h.start : h.end].encode()) == decontaminate.words_of(texts[r.doc_id].encode())[h.first : h.last + 1]


def test_contamination_cases(spark, docs, empty, repeated):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.judge_documents(empty, items).collect() == []
    assert not any(r.n_hit for r in decontaminate.judge_documents(docs, items.limit(0)).collect())
    assert decontaminate.judge_documents(repeated, items).count() == repeated.count()
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_repeated_rows_stay_with_several_automata(spark, repeated):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.find_passages(repeated, items, pattern_bytes=200).count() == repeated.count()
    same = spark.createDataFrame([(1, "a short item"), (1, "a short item"), (1, "nothing of it"), (None, None)], "doc_id long, text string")
    found = decontaminate.find_passages(same, items, pattern_bytes=200)
    assert sorted((r.n_words, len(r.hits)) for r in found.collect()) == [(0, 0), (3, 0), (3, 2), (3, 2)]


# --- chat

control = st.text(st.sampled_from(list("<|\\>im_start end:0\nab")), max_size=30)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "x\\n<|im_end|>"]), control), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    c = chat.Conversation(1)
    for role, text in turns:
        c.turn(role, [{"type": "text", "text": text, "ref": None, "tokens": None}])
    row = c.row()
    back, loss = chat.parse_chat(row["formatted"], row["loss_spans"])
    assert back == turns and loss == [t for r, t in turns if r == "assistant" and t]


def test_chat_parts(spark):
    parts = "array<struct<type: string, text: string, ref: string, tokens: int>>"
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]), (1, 1, "assistant", [("text", "ok <|image:0|>", None, None), ("document", None, "c.pdf", None)]), (2, 0, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    a = got[1]
    assert [(x.kind, x.ref, x.turn, x.tokens) for x in a.attachments] == [("image", "a.png", 0, 256), ("audio", "b.wav", 0, 7), ("document", "c.pdf", 1, 512)]
    assert all(a.formatted[x.start :].startswith(f"<|{x.kind}:{k}|>") for k, x in enumerate(a.attachments)) and a.extra_tokens == 775
    assert chat.parse_chat(a.formatted, a.loss_spans) == ([("user", "see "), ("assistant", "ok <|image:0|>")], ["ok <|image:0|>"])
    assert got[2].n_turns == 1
    assert chat.format_chat(df.limit(0)).collect() == []


def test_chat_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, 0, "user", "a", 2), (1, None, None, None, 3), (None, 1, "assistant", "x", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: chat.parse_chat(r.formatted, [])[0] for r in chat.format_chat(chat.text_parts(df)).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}


def test_chat_ties_go_by_the_text_itself(spark):
    """JSON would put a quote, a newline and a backslash behind letters."""
    texts = ['"quoted', "Alpha", "\nline", "\\back", "", "zeta", "[x", "\tab"]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    row = chat.format_chat(chat.text_parts(df)).first()
    assert [t for _, t in chat.parse_chat(row.formatted, [])[0]] == sorted(texts)


# --- URL filters


def test_url_cases(spark):
    urls = ["http://WWW.Example.COM/en/1", "https://example.com/en/", "x://com", "http://notexample.com/en/x", "a://sub.net/es/?q#f", "http://net/fr/#x", "no scheme", None, "", "http://example.com?x=/en/", "http://example.com./en/", "x\ny://a.com/\nb"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.RULES, keep=("page_id",)).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("com", "", None, "allow"), 3: ("notexample.com", "/en/x", "com/", "allow"),
        4: ("sub.net", "/es/", "net/es/", "block"), 5: ("net", "/fr/", "net/fr/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("example.com", "", None, "allow"),
        10: ("example.com.", "/en/", None, "allow"), 11: ("a.com", "/\nb", "com/", "allow"),
    }
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    """With a weak first level, so that several levels are needed."""
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 5000, 7).selectExpr("concat('k', id) as key")
    made = url_filter.build_cascade(listed, universe, rate=0.4)
    got = {r.key for r in made.attach(universe).where(made.contains(universe["key"])).select("key").collect()}
    assert len(made.levels) > 2 and got == {f"k{i}" for i in range(0, 5000, 7)}


# --- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.saved(out)
        now = {r.doc_id for r in docs.collect()}
        assert now <= start and len(now) > 0.7 * len(start)
        start = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == start
    check_places(rows)


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on its own input: the rows and texts that a plain version keeps."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}

    texts = read(docs)
    model = langid.fit(langid.labelled_sample(docs, langid._remainder(4) != 2))
    langs, _ = model.predict([t.encode() for t in texts.values()])
    docs = corpus_pipeline.saved(stages["language"](spark, docs, SMALL))
    assert read(docs) == {i: t for (i, t), la in zip(texts.items(), langs, strict=True) if la != "und"}

    texts = read(docs)
    groups = brute.grouped({i: brute.fingerprint(t) for i, t in texts.items()})
    docs = corpus_pipeline.saved(stages["near duplicates"](spark, docs, SMALL))
    assert read(docs) == {i: t for i, t in texts.items() if groups[i] == i}

    texts = read(docs)
    plain = brute.repeats(list(texts.items()))
    docs = corpus_pipeline.saved(stages["repeated passages"](spark, docs, SMALL))
    cut = read(docs)
    kept = {i: hashlib.sha256(" ".join(brute.WORD.findall(t)).encode()).hexdigest() for i, t in cut.items()}
    assert kept == {i: digest for i, (n, gone, digest) in plain.items() if not n or gone < n}
    assert all(cut[i] == texts[i] for i in cut if not plain[i][1])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = corpus_pipeline.saved(stages["benchmark passages"](spark, docs, SMALL))
    assert read(docs) == {i: t for i, t in cut.items() if not brute.contaminated(t, items)}

    rows = stages["packing"](spark, docs, SMALL).collect()
    encode = packing.encoder(packing.vocabulary_path()).tokenizer.encode
    check_places(rows)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == {
        (i, k, 4096 * k, len(part), zlib.crc32(np.array(part, np.uint32).tobytes()))
        for i, t in read(docs).items() for ids in [[*encode(t, add_special_tokens=False).ids, 1]] for k in range(-(-len(ids) // 4096)) for part in [ids[4096 * k : 4096 * (k + 1)]]
    }


def test_stages_take_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).collect() == []


def test_texts_of_the_tables_are_never_shortened():
    d = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])
    assert max(map(len, d["text"].to_pylist())) > 5000
