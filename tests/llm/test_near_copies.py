"""SimHash groups and repeated passages against plain versions, by every path."""

import brute
import numpy as np
import pytest
from conftest import REPEATED, ROWS, passage

from corpusloom.llm import simhash, substring
from corpusloom.llm.graph import components


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("rows", [ROWS, REPEATED])
def test_simhash(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: brute.fingerprint(t) for i, t in rows}
    groups = brute.grouped(prints)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert all(r.fp == signed(prints[r.doc_id]) and r.component_id == groups[r.doc_id] for r in got)


def test_simhash_cases(docs, empty, unnamed):
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(unnamed).collect()}
    assert got == {(None, 0), (0, 0), (None, None)}
    kept = simhash.drop_near_duplicates(docs)
    groups = brute.grouped({i: brute.fingerprint(t) for i, t in ROWS})
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(groups.values())


@pytest.mark.parametrize("most", [1, 6, 1000])
def test_links_give_the_same_components_by_every_path(spark, most):
    rng = np.random.default_rng(most)
    values = {int(v) for v in rng.integers(0, 2**63, 60)}
    for base in list(values)[:3]:
        for _ in range(60):
            v = base
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    want = brute.grouped({signed(v): v for v in values})
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df, len(values), most)).collect()}
    groups = lambda f: {frozenset(k for k in want if f(k) == x) for x in {f(k) for k in want}}
    assert groups(lambda k: root.get(k, k)) == groups(lambda k: want[k])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def removed(ranges):
    return sum(x["last"] - x["first"] + 1 for x in ranges)


@pytest.mark.parametrize(("rows", "most"), [(512, 4_000_000), (7, 4_000_000), (1, 60), (512, 60)])
def test_repeats(spark, rows, most):
    """One passage in 40 different surroundings; shards of every size, and several automata for one shard."""
    many = [(100 + i, f"own{i} words{i} " + ROWS[0][1][:400] + f" tail{i}") for i in range(40)]
    df = spark.createDataFrame([*ROWS, *many], "doc_id long, text string").repartition(5)
    found = {r.doc_id: removed(r.ranges) for r in substring.repeated_ranges(df, rows=rows, most=most).collect()}
    assert found == {i: gone for i, (_, gone, _) in brute.repeats([*ROWS, *many]).items()}


@pytest.mark.parametrize("rows", [1, 3, 512])
@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_passages(spark, seed, rows):
    """Few different words and short pieces in any order, so that windows recur at all offsets."""
    rng = np.random.default_rng(seed)
    pieces = [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(5, 60))) for _ in range(8)]
    docs = [(int(i), " ".join(pieces[k] for k in rng.integers(0, 8, rng.integers(0, 9)))) for i in rng.permutation(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r.doc_id: removed(r.ranges) for r in substring.repeated_ranges(df, rows=rows).collect()}
    assert found == {i: gone for i, (_, gone, _) in brute.repeats(docs).items()}


@pytest.mark.parametrize("rows", [1, 512])
def test_rows_with_one_id_and_different_texts(spark, rows):
    a, b = passage(21, 100), passage(22, 10)
    cases = [(1, a), (2, a), (2, b), (2, a), (3, b + " " + passage(23, 30)), (3, passage(23, 30) + " " + b), (None, a), (2, None)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    found = sorted((r.doc_id or 0, removed(r.ranges)) for r in substring.repeated_ranges(df, rows=rows).collect())
    assert found == [(0, 0), (1, 0), (2, 0), (2, 0), (2, 100), (2, 100), (3, 0), (3, 30)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in substring.without_repeats(df).collect())
    assert [x for x in kept if x[0] < 3] == [(0, a), (1, a), (2, ""), (2, b)]


def test_repeats_cases(spark, docs, empty, unnamed, repeated):
    assert substring.repeated_ranges(empty).collect() == [] and substring.without_repeats(empty).collect() == []
    assert not any(r.ranges for r in substring.repeated_ranges(unnamed).collect())  # rows without an id have no place in the order
    ranges = lambda df: {(r.doc_id, tuple(r.ranges)) for r in substring.repeated_ranges(df).collect()}
    assert ranges(docs) == ranges(repeated) and substring.repeated_ranges(repeated).count() == repeated.count()
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns
    left = by_id(kept, "text", "n_chars")
    assert 1 not in left and left[0] == (ROWS[0][1], len(ROWS[0][1])) and left[5] == (None, 0) and left[4] == ("", 0) and left[6][0] == ROWS[6][1]
    assert left[3][0].startswith(ROWS[3][1][:50]) and len(left[3][0].split()) == 60


def test_op8_on_the_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    want = brute.repeats(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)))
    assert by_id(substring.op8_substring_dedup(spark, "/root/testdata/sf0.001"), "n_words", "n_removed", "kept_sha256") == want


def test_op4_on_the_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    prints = {i: brute.fingerprint(t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)}
    groups = brute.grouped(prints)
    assert by_id(simhash.op4_simhash_near_dedup(spark, "/root/testdata/sf0.001"), "fingerprint", "component_id") == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_op4_broadcasts_no_table(spark, docs, monkeypatch):
    """However small its tables look, none goes to the driver: they grow with the corpus."""
    from corpusloom.llm import graph

    plans = []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (graph, simhash):
        monkeypatch.setattr(module, "saved", lambda df, keep=module.saved: (plans.append(plan_of(df)), keep(df))[1])
    plans.append(plan_of(simhash.drop_near_duplicates(docs)))
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
