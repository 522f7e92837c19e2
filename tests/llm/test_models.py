"""Language identification, language-model scores, quality rules and licence scans."""

import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import ROWS

from corpusloom.llm import langid, licenses, lm, quality

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name, folder="/root/testdata/sf0.01"):
    return pq.read_table(f"{folder}/{name}.parquet").to_pandas()


@pytest.fixture(scope="module")
def models():
    d = table("documents")
    held = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    return langid.fit([(la, t.encode()) for la, t in zip(d.lang[~held], d.text[~held], strict=True)]), d[held]


def test_language_held_out(models):
    model, d = models
    langs, scores = model.predict([t.encode() for t in d.text])
    assert sum(a == b for a, b in zip(langs, d.lang, strict=True)) >= 0.98 * len(d)
    assert all(0 <= s <= 1 for s in scores)


def test_language_rejects(models):
    langs, scores = models[0].predict([None, b"", b"12 345 --", "Привет как дела сегодня вечером".encode(), "你好世界今天天气很好".encode()])
    assert langs == ["und"] * 5 and scores == [0.0] * 5


def test_probabilities_sum_to_one(models):
    """Over all characters of the alphabet and one unknown, after any context."""
    model, d = models
    known = sorted({c for t in d.text[:80] for c in t.lower() if c.isalpha()} | {" "})
    for context in ("the", "zzq", "ein"):
        total = [0.0] * len(model.langs)
        for c in known:
            full, _, _ = model.entropy([(context + "a" + c).encode() if c != " " else (context + "a ").encode()])
            part, _, _ = model.entropy([(context + "a").encode()])
            n = len(context) + 1
            total = [s + 2 ** -(f * (n + 1) - p * n) for s, f, p in zip(total, full[0], part[0], strict=True)]
        assert all(0.9 < s < 1.0001 for s in total)


def test_language_cases(docs, empty, unnamed):
    none = langid.fit([])
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.drop_unidentified(empty).collect() == []
    model = langid.fit(langid.labelled_sample(docs, langid._remainder(4) != 2))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert len(got) == len(ROWS) and got[4] == got[5] == got[6] == "und"
    assert langid.drop_unidentified(docs).columns == docs.columns
    assert langid.identify(unnamed, model).count() == 3


def test_lm_base_and_share(spark):
    got = lm.op5_lm_scoring(spark, SMALL).toPandas().set_index("doc_id")
    d = table("documents", SMALL)
    words = {i: [*WORD.findall(t.translate(LOWER)), ""] for i, t in zip(d.doc_id, d.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert 1 < got.bits_per_byte.mean() < 4 and (got.score < 0).all()


def test_lm_rare_words_join(spark):
    from corpusloom.llm.common import read_table

    d = read_table(spark, SMALL, "documents")
    some, all_ = (lm.score_texts(d, ~lm._remainder(), top=t).toPandas().set_index("doc_id") for t in (20, 150_000))
    assert (some.base_score - all_.base_score).abs().max() < 1e-6 and (some.n_known == all_.n_known).all()


def test_lm_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("abab abac",), ("abba",), (None,)], "text string")
    mixer = lm.train(texts)
    import numpy as np

    base = int(lm.runs_of([b"abab"])[0][3]) & ~255
    total = 10 ** mixer.cost(np.array([base | b for b in range(256)], np.uint64))
    assert total.sum() == pytest.approx(1, abs=1e-6)


def test_lm_counts_stay_apart(spark):
    """Far more contexts than a table of 2^20 places holds: a text learned three times stays cheap, one not learned doesn't."""
    import random

    pick = random.Random(1)
    texts = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=150)) for _ in range(2000)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(3)] + [(-1 - i, "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=150))) for i in range(20)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lm.F.col("doc_id") >= 0).toPandas()
    assert got[got.doc_id >= 0].bits_per_byte.mean() < 1 and got[got.doc_id < 0].bits_per_byte.mean() > 4


def foretold_plainly(lines, counted):
    """(state, hit) of every word of every line, by loops over tuples of words."""
    words = lm.Words.of(lines)
    kept = dict(zip(words.anchors.tolist(), zip(words.contexts.tolist(), words.lengths.tolist(), strict=True), strict=True))
    table = {}
    for a, (c, n) in kept.items():
        if counted[words.owner[a]]:
            table.setdefault(c, []).append(words.short[a : a + n].tolist())

    def until_they_part(all_):
        out = []
        for x in zip(*all_, strict=False):
            if len(set(x)) > 1:
                break
            out.append(x[0])
        return out

    out, told, n, k, row = [], [], 0, 0, 0
    for i in range(len(words.short)):
        if not i or words.owner[i] != words.owner[i - 1]:
            told, row = [], 0
        if i in kept:
            all_ = table.get(kept[i][0], [])
            n, k = len(all_) - bool(counted[words.owner[i]]), 0
            told = until_they_part(all_) if n > 0 else []
        if not told:
            out.append((-1, False))
            continue
        hit = told.pop(0) == words.short[i]
        out.append((min(n, lm.COUNTED) - 1 + lm.COUNTED * (k > 0) + min(row, lm.ROWED - 1) * 2 * lm.COUNTED, hit))
        row, k, told = (row + 1, k + 1, told) if hit else (0, 0, [])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lm_foretells_recurring_words(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    pieces = [" ".join(f"w{x}" for x in rng.integers(0, 90, rng.integers(3, 90))) for _ in range(9)]
    lines = [lm.plain(" ".join(pieces[k] for k in rng.integers(0, 9, rng.integers(0, 12))).encode()) for _ in range(40)]
    counted = rng.random(40) < 0.7
    df = spark.createDataFrame([(i % 2, t.decode(), bool(y)) for i, (t, y) in enumerate(zip(lines, counted, strict=True))], "block long, text string, counted boolean").repartition(3)
    got = {}
    for r in lm.foretold(df).collect():
        got.setdefault(r.block, []).append(np.frombuffer(r.told, np.int64).reshape(-1, 3 + len(lm.AFTER)))
    want = foretold_plainly(lines, counted)
    owner = lm.Words.of(lines).owner
    assert sum(s >= 0 for s, _ in want) > 100 and any(h for _, h in want)
    for block, tables in got.items():
        some = [i for i in range(40) if i % 2 == block]
        state, hit = lm.Foretold(np.concatenate(tables)).states(lm.Words.of([lines[i] for i in some]), counted[some])
        assert list(zip(state.tolist(), hit.tolist(), strict=True)) == [x for x, o in zip(want, owner, strict=True) if o in some]


def test_lm_scores_do_not_depend_on_neighbours(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lm.score_texts(d.repartition(n, "doc_id"), ~lm._remainder()).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=2e-3) for i in a)


def test_lm_beats_the_unigram_on_texts_it_did_not_learn(spark):
    got = lm.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


@pytest.fixture(scope="module")
def four_megabytes():
    import random

    pick = random.Random(5)
    words = ["".join(pick.choices("abcdefghijklmnop", k=pick.randint(1, 9))) for _ in range(1000)]
    texts = [" ".join(pick.choices(words, k=650)) for _ in range(1000)]
    columns = [[7] * 1000, texts, [i % 3 > 0 for i in range(1000)], [i % 3 > 0 for i in range(1000)]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "text", "learned", "counted"])


@pytest.mark.parametrize("step", [lm._block_runs, lm._block_contexts])
def test_lm_counting_holds_little_at_once(four_megabytes, step):
    tracemalloc.start()
    assert sum(x.num_rows for x in step(iter([four_megabytes])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 << 20, peak


@pytest.mark.parametrize("held", [lm.KEPT, 40_000])
def test_lm_counts_are_whole_however_little_is_held(four_megabytes, monkeypatch, held):
    import numpy as np

    monkeypatch.setattr(lm, "KEPT", held)
    monkeypatch.setattr(lm, "ADDED", held // 2)
    monkeypatch.setattr(lm, "CHUNK", 30_000)
    lines = [lm.plain(t.encode()) for t in four_megabytes.column("text").to_pylist()]
    learned = np.array(four_megabytes.column("learned").to_pylist())
    runs, sizes = lm.runs_of(lines)
    want = np.unique(runs, return_inverse=True)
    parts = pa.Table.from_batches(lm._block_runs(iter([four_megabytes])))
    got, n = lm.summed(parts["run"].to_numpy().astype(np.uint64), parts["n"].to_numpy())
    assert (got == want[0]).all() and (n == np.bincount(want[1], weights=np.repeat(learned, sizes))).all()
    assert (len(parts) > len(got)) == (held == 40_000)

    words = lm.Words.of(lines)
    want = np.unique(words.contexts, return_inverse=True)
    parts = pa.Table.from_batches(lm._block_contexts(iter([four_megabytes])))
    assert (parts["context"].to_numpy() == want[0]).all()
    for name, some in (("n", learned), ("u", ~learned)):
        assert (parts[name].to_numpy() == np.bincount(want[1], weights=some[words.owner[words.anchors]])).all()


def test_lm_cases(spark, docs, empty, repeated, unnamed):
    assert lm.score_texts(empty, ~lm._remainder()).collect() == []
    got = lm.score_texts(docs, ~lm._remainder()).collect()
    assert len(got) == len(ROWS)
    a = {r.doc_id: r.score for r in got}
    assert a[4] == a[5] == a[6] < 0
    assert lm.score_texts(repeated, ~lm._remainder()).count() == repeated.count()
    assert lm.score_texts(unnamed, ~lm._remainder()).count() == 3


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit)


def test_quality_counts(docs):
    made = {r.doc_id: r for r in quality.score_quality(docs, quality.Classifier([], 0.0)).collect()}
    for i, t in ROWS:
        r, n = made[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r.kept == (not r.base_failed)


def test_quality_held_out():
    d, la = table("documents", "/root/testdata/sf0.1"), table("labels", "/root/testdata/sf0.1")
    text = dict(zip(d.doc_id, d.text, strict=True))
    rows = [(q, text[i].encode()) for i, q in zip(la.doc_id, la.quality, strict=True)]
    model, rest = quality.fit(rows[:1500]), rows[1500:]
    p = model.probability(quality.Step.of([t for _, t in rest]))
    fair = [counts(t.decode()) for _, t in rest]
    ok = [n[0] >= 50 and 2 * n[4] <= n[0] for n in fair]
    good = [x >= quality.KEEP_AT for x, (q, _), y in zip(p, rest, ok, strict=True) if q == 1 and y]
    bad = [x >= quality.KEEP_AT for x, (q, _), y in zip(p, rest, ok, strict=True) if q == 0 and y]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    assert len(quality.labelled_sample(docs, labels)) == 2
    assert quality.score_quality(empty, quality.fit([])).collect() == []


def test_licences(spark):
    lines = [("gpl", "This work is licensed under the GNU General Public License, version 3."), ("mit", "Released under the MIT License."), ("apache", "Licensed under the Apache License, Version 2.0."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), (None, "The river ran past the old mill and the people of the town walked there."), (None, "He was licensed to drive a bus through the hills of the north.")]
    background = [(100 + i, f"plain words about number {i} and the weather near the {i} hills\nanother line of prose {i}", 0) for i in range(60)]
    rows = [(i, f"intro text\n{line}\nmore text", 1) for i, (_, line) in enumerate(lines)] + background + [(7, None, 0), (8, "", 0), (0, f"intro text\n{lines[0][1]}\nmore text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan_licences(df).collect() if r.confirmed]
    assert sorted(got) == sorted([(i, 1, f, True) for i, (f, _) in enumerate(lines) if f] + [(0, 1, "gpl", True)])
    assert licenses.scan_licences(df.limit(0)).collect() == []


def kneser_ney(texts, order=langid.ORDER):
    """(probability of a character behind a context, by plain dictionaries; the characters met), from prepared lines."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        for i in range(order - 1, len(t)):
            for k in range(1, order + 1):
                grams[k][t[i - k + 1 : i + 1]] += 1
    counts = [Counter() for _ in range(order + 1)]
    counts[order] = grams[order]
    for k in range(1, order):
        before = Counter(g[1:] for g in grams[k + 1])
        counts[k] = Counter({g: before.get(g, 1) for g in grams[k]})

    def p(context, char, k=order):
        if not k:
            return None
        below = p(context, char, k - 1)
        own = context[len(context) - k + 1 :]
        values = list(counts[k].values())
        once, twice = values.count(1), values.count(2)
        cut = once / (once + 2 * twice) if once else 0.5
        here = {g: c for g, c in counts[k].items() if g[:-1] == own}
        if not here:
            return below
        total = sum(here.values())
        return max(here.get(own + char, 0) - cut, 0) / total + cut * len(here) / total * (base if below is None else below)

    alphabet = set()
    base = None

    def cost(t, letters):
        nonlocal base
        base = 1 / (len(letters) + 1)
        return sum(-math.log2(p(t[i - order + 1 : i], t[i])  or base) for i in range(order - 1, len(t)))

    alphabet = {c for t in texts for c in t}
    return cost, alphabet


def test_language_models_against_plain_kneser_ney():
    train = {"de": ["Der Hund läuft über die Wiese", "Die Sonne scheint auf den Hügel", "Wir gehen heute in die Stadt"], "en": ["The dog runs over the meadow", "the sun shines on the hill", "We go to town today, again"]}
    prepared = lambda t: " " * (langid.ORDER - 1) + re.sub(r"[^a-zäöüß]+", " ", t.lower())
    model = langid.fit([(la, t.encode()) for la, ts in train.items() for t in ts])
    plain = {la: kneser_ney([prepared(t) for t in ts]) for la, ts in train.items()}
    letters = set.union(*(a for _, a in plain.values()))
    for text in ["The sun runs", "Der Hund geht", "zebra"]:
        bits, sizes, _ = model.entropy([text.encode()])
        line = prepared(text)
        assert sizes[0] == len(line) - langid.ORDER + 1
        for j, la in enumerate(model.langs):
            assert bits[0][j] * sizes[0] == pytest.approx(plain[la][0](line, letters), rel=1e-4)


def test_scoring_holds_little_at_once():
    models = langid.fit([("en", b"the cat sat on the mat and ran"), ("fr", "le chat est sur la table à côté".encode()), ("de", b"die katze sitzt auf dem tisch")] * 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array(["the cat sat on a table and " * 151] * 1024)], ["doc_id", "text"])
    seen = []
    tracemalloc.start()
    for part in langid._predict(SimpleNamespace(value=models))(iter([batch])):
        seen += part.column("lang_pred").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(seen)) == 1 and len(seen) == 1024 and seen[:1] == models.predict([batch.column("text")[0].as_py().encode()])[0]
    assert peak < 64 << 20, peak
