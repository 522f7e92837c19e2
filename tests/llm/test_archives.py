"""WARC archives, Merkle manifests and ranked search."""

import base64
import gzip
import hashlib
import json

import brute
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from conftest import REPEATED, ROWS, passage
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import merkle, search, warc
from corpusloom.llm.common import new_folder

SMALL = "/root/testdata/sf0.001"


# --- WARC


def record(n, payload):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{warc.digest_of(payload)}\r\nContent-Length: {len(payload) + 4}\r\n\r\n".encode() + b"X\r\n\r\n"[1:] + payload + b"\r\n\r\n"


PAYLOADS = [b"", b"one", b"\r\n\r\nWARC/1.0\r\n\r\n", b"x" * (2 * warc.PIECE + 7), bytes(range(256)) * 9]


@pytest.mark.parametrize("members", [1, 2, 5])
def test_normaliser_gives_each_record_a_member(tmp_path, members):
    records = [record(i, p) for i, p in enumerate(PAYLOADS)]
    cuts = np.array_split(np.arange(len(records)), members)
    whole = b"".join(records)
    data = gzip.compress(whole) if members == 1 else b"".join(gzip.compress(b"".join(records[i] for i in c)) for c in cuts)
    (tmp_path / "a").write_bytes(data)
    fs = pafs.LocalFileSystem()
    n, size = warc.normalise_file(fs, str(tmp_path / "a"), fs, str(tmp_path / "b"))
    made, index = (tmp_path / "b").read_bytes(), [json.loads(x) for x in (tmp_path / "b.idx").read_text().splitlines()]
    assert n == len(records) == len(index) and size == len(made) and gzip.decompress(made) == whole
    for row, raw, payload in zip(index, records, PAYLOADS, strict=True):
        one = gzip.decompress(made[row["offset"] : row["offset"] + row["length"]])
        assert one == raw and warc.parse_record(one)["payload"] == payload
    assert sum(r["length"] for r in index) == len(made)


def test_normaliser_refuses_a_cut_stream(tmp_path):
    data = gzip.compress(b"".join(record(i, p) for i, p in enumerate(PAYLOADS)))
    fs = pafs.LocalFileSystem()
    for k, cut in enumerate((data[:-30], gzip.compress(record(0, b"abc")[:-6]), gzip.compress(record(0, b"abc") + b"WARC/1.0\r\nWARC"))):
        (tmp_path / f"{k}").write_bytes(cut)
        with pytest.raises(EOFError):
            warc.normalise_file(fs, str(tmp_path / f"{k}"), fs, str(tmp_path / f"{k}b"))


def pages_of(rows):
    """What the contract says: (page_id, bytes, digest, type, refers_to)."""
    out, groups = [], {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        last = max(ids) if ids else None
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    return sorted(out, key=str)


PAGES = [(1, "http://a/", "<p>é"), (2, None, None), (3, "http://b/\r\nWARC-Type: fake x", "<p>é"), (4, "", ""), (None, "u", "<p>é"), (5, "http://c", "x" * 3_000_000), (6, "d", "y"), (7, "e", "\r\n\r\n"), (None, "f", "lone")]


def read_pages(spark, rows, extra=True, **options):
    df = spark.createDataFrame([(*r, "z", 1, b"q", True) for r in rows], "page_id long, url string, html string, key string, last int, payload binary, revisit boolean")
    archives, folder = warc.archive_pages(df, **options)
    return archives, folder, warc.read_index(archives, folder)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"archive_bytes": 500}])
def test_pages_come_back(spark, options):
    archives, folder, index = read_pages(spark, [*PAGES, PAGES[0]], **options)
    records = warc.read_records(index, folder).collect()
    got = sorted(((warc.page_of(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc.page_of(r.refers_to)) for r in records), key=str)
    assert got == pages_of([*PAGES, PAGES[0]])
    bodies = {warc.page_of(r.record_id): bytes(r.payload) for r in records if r.record_type == "response" and r.record_id != "<urn:page:null>"}
    assert all(body.decode() == (next(h for i, _, h in PAGES if i == page) or "") for page, body in bodies.items())
    assert {r.url for r in records if r.record_id == "<urn:page:3>"} == {"http://b/%0D%0AWARC-Type:%20fake%20x"}
    assert archives.agg({"records": "sum"}).first()[0] == index.count() == len(PAGES) + 1


def test_short_payloads_are_all_responses_and_none_is_none(spark):
    _, folder, index = read_pages(spark, PAGES, least=4)
    kinds = {(r.record_id, r.payload_bytes): r.record_type for r in warc.read_records(index, folder).collect()}
    assert kinds[("<urn:page:2>", 0)] == kinds[("<urn:page:4>", 0)] == "response" and kinds[("<urn:page:1>", 5)] == "revisit"
    _, folder, index = read_pages(spark, [])
    assert warc.read_records(index, folder).count() == 0


def test_file_systems():
    assert warc.files("file:/a/b")[1] == warc.files("/a/b")[1] == warc.files("file:///a/b")[1] == "/a/b"


# --- Merkle trees


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(0, 2))
def test_traversal_gives_the_plain_proofs(n, more):
    leaves = [brute.sha(str(i)) for i in range(n)]
    levels, height = brute.tree(leaves), (n - 1).bit_length() + more
    for k in range(more):
        levels.append([brute.sha(levels[-1][0])])
    paths = [list(p) for p in merkle.traverse([x.encode() for x in leaves], height)]
    assert merkle.treehash([x.encode() for x in leaves], height).decode() == levels[-1][0]
    for i, path in enumerate(paths):
        assert [x and x.decode() for x in path] == [x for x, _ in brute.proof(levels, i)]
        assert merkle.fold(leaves[i].encode(), merkle.encode(path, i)).decode() == levels[-1][0]


def test_traversal_keeps_few_nodes(monkeypatch):
    most, made = 0, []
    init = merkle.Treehash.__init__
    monkeypatch.setattr(merkle.Treehash, "__init__", lambda self, *a, **b: (init(self, *a, **b), made.append(self))[0])
    for _ in merkle.traverse([b"%064d" % i for i in range(256)], 8):
        live = {id(s): s for s in made[-64:]}.values()
        most = max(most, sum(len(s.stack) for s in live if s.low < 1 << 30))
    assert most <= 3 * 8


MERKLE = [
    *[(i, passage(i, 5), "en", "s", i) for i in range(37)], *[(100 - i, f"t{i}", "de", None, None) for i in range(9)], (None, None, None, None, None), (5, "é", None, "s", 2), (5, "é", None, "s", 2), (7, "", "", "", 0),
    (None, "b", "en", "s", 1), (None, "a", "en", "s", 1), (3, "same", "en", "s", 9), (3, "same", "en", "s", 9),
]


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest_equals_plain_trees(spark, levels):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    df = spark.createDataFrame([(*r, "x", b"y", 1, 2) for r in MERKLE], "doc_id long, text string, lang string, source string, n_chars long, leaf string, path binary, tree int, i int")
    got = sorted(map(tuple, merkle.proofs(df, levels).collect()), key=str)
    assert got == brute.merkle([dict(zip(names, r, strict=True)) for r in MERKLE])


def test_manifest_of_few_rows(spark, empty):
    assert merkle.proofs(empty).count() == 0
    one = merkle.proofs(spark.createDataFrame([(7, "a", "en", "s", 1)], empty.schema)).collect()[0]
    assert one.root == one.subroot == one.leaf and one.proof_sha256 == brute.sha()
    two = merkle.proofs(spark.createDataFrame([(7, "a", "en", "s", 1), (8, "a", None, "s", 1)], empty.schema)).collect()
    assert len({r.root for r in two}) == 1 and all(r.subroot == r.leaf for r in two)


# --- search

ITEMS = [(1, passage(1, 40)), (2, passage(3, 20) + " 中文 ÉTÉ"), (3, None), (4, " .,- "), (5, "quick1 ONE two"), (None, "the other end"), (6, "nowhere"), (7, passage(2, 10)), (7, passage(4, 10))]


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("query_bytes", [search.QUERY_BYTES, 300])
def test_search_equals_plain_scores(spark, docs, query_bytes):
    items = spark.createDataFrame([(*r, 1, "x") for r in ITEMS], "item_id long, text string, rank int, doc_id string")
    for k in (1, 3, 50):
        assert found(search.search(docs, items, k, query_bytes)) == brute.ranked(ROWS, ITEMS, k)


def test_search_cases(spark, repeated, unnamed, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(search.search(repeated, items, 4)) == brute.ranked(REPEATED, ITEMS, 4)
    rows = [tuple(r) for r in unnamed.select("doc_id", "text").collect()]
    assert found(search.search(unnamed, items, 2)) == brute.ranked(rows, ITEMS, 2)
    assert search.search(empty, items).count() == search.search(unnamed, items.limit(0)).count() == 0
    copies = [(i, "alpha beta gamma") for i in range(700)] + [(1000 + i, f"alpha w{i}") for i in range(300)]
    asked = [(1, "alpha"), (2, "beta w5"), (3, "gamma alpha")]
    got = search.search(spark.createDataFrame(copies, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), 50)
    assert found(got) == brute.ranked(copies, asked, 50)


def test_search_stops_early(spark):
    """Items meet fewer clusters than hold their terms, and a bisected order is better than none."""
    rng = np.random.default_rng(3)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(16)]
    rows = [(i, " ".join(rng.choice(topics[i % 16], 30)) + (" common words here" if i % 3 else "")) for i in range(6000)]  # 'common' has a weight, so each item has a bound everywhere
    items = [(t, " ".join(topics[t][:8]) + " common") for t in range(16)]
    trace = []
    got = search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10, trace=trace)
    assert found(got) == brute.ranked(rows, items, 10)
    assert sum(seen for seen, _ in trace) < 0.5 * trace[0][1]


def test_bisection_puts_like_documents_together():
    lists = pa.array([[8 * (i % 4) + j for j in range(8)] for i in range(64)], pa.list_(pa.int32()))
    clusters = search.bisected(search.Graph(lists), 64, 16)
    assert sorted(np.concatenate(clusters).tolist()) == list(range(64))
    assert all(len({i % 4 for i in c.tolist()}) == 1 for c in clusters)


def test_folders_are_apart(spark):
    assert new_folder(spark) != new_folder(spark)
