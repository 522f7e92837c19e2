"""Ranked lexical search: the best documents for each query, by integer scores, through a clustered index with exact stopping.

Terms are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. The index holds the terms that the
queries ask for; counts and weights are those of all documents. Queries come in blocks of QUERY_BYTES of terms, each with
an index of its own, so that what is broadcast has a bound.

Documents are reordered by recursive graph bisection of the graph of documents and terms: a segment is halved, then
documents swap sides while that lowers the log-gap cost of the terms' lists. The first TOP levels are learned from
FIT_ROWS documents of least hash (of FIT_EDGES terms at most) and route every document by the terms' leanings; each of the
2**TOP parts is dealt by hash to shards of bounded size, whose documents are bisected in a task down to clusters of CLUSTER neighbours.

A cluster keeps each term's largest contribution, so an item's sum of them bounds all scores in the cluster. Items visit
clusters by falling bound, a few in the first wave and eight times more in each next one; the k-th score so far is the
threshold, and clusters below it are never visited. A cluster at the threshold is, as it may hold a tie with a smaller
doc_id. When no cluster is left, the result is exact, whatever the order of the documents.

Cases: a null text has no term; an item with none gets no row. Items of one id (null too) are one, with the terms of all their texts.
Repeated rows are documents of their own and rank one after the other. Null doc_ids come last among equal scores. Empty
tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, least_hashed, mix, read_table, saved, small_batches, steps
from .decontaminate import words_of

K = 50
#: Bytes of query terms that one index serves.
QUERY_BYTES = 4 << 20
#: Levels of bisection that are learned, and the documents and terms from which. They steer cost, never the result.
TOP, FIT_ROWS, FIT_EDGES = 5, 4096, 2_000_000
#: Documents of a shard, and its documents' distinct terms; documents of a cluster.
SHARD, SHARD_EDGES, CLUSTER = 8192, 2_000_000, 256
#: Rounds of swaps at most for a segment.
ROUNDS = 20
#: Clusters that an item visits first.
FIRST = 4
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<long>"
INDEX = "cluster long, ids array<long>, terms binary, ptr binary, docs binary, impacts binary, peaks binary"


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        for i, text in enumerate(as_bytes(batch.column("text"))):
            if terms := sorted(set(words_of(text))):
                ids = pa.DictionaryArray.from_arrays(pa.array([0] * len(terms), pa.int32()), batch.column("item_id").slice(i, 1)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary())], ["item_id", "term"])


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in steps(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                sizes.append(len(words))
                if words:
                    counts = Counter(words)
                    for term in counts.keys() & known.keys():
                        terms.append(known[term])
                        tfs.append(counts[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Graph:
    """Documents and their terms, the lists one after the other."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.ptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        self.terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def edges(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among docs and term of every edge of them."""
        sizes = self.ptr[docs + 1] - self.ptr[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ptr[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(docs)), sizes), self.terms[at]


def halved(places: np.ndarray, terms: np.ndarray, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n documents whether it goes right, and each term's documents on the left and on the right.

    The start puts documents with the same least hashed term together; an even mixture of like documents would have no better half.
    """
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, places, mix(terms.astype(np.uint64) + np.uint64(1)))
    right = np.zeros(n, bool)
    right[np.argsort(least, kind="stable")[(n + 1) // 2 :]] = True
    sizes = np.array([n - right.sum(), right.sum()], float)
    width = int(terms.max()) + 1 if len(terms) else 0
    total = np.bincount(terms, minlength=width)

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.log2(sizes[0] / (a + 1)) + b * np.log2(sizes[1] / (b + 1))

    for k in range(rounds + 1):
        b = np.bincount(terms, weights=right[places], minlength=width)
        a = total - b
        if k == rounds:
            break
        now = cost(a, b)
        to_right, to_left = now - cost(np.maximum(a - 1, 0), b + 1), now - cost(a + 1, np.maximum(b - 1, 0))
        gain = np.bincount(places, weights=np.where(right[places], to_left[terms], to_right[terms]), minlength=n)
        sides = [np.flatnonzero(~right), np.flatnonzero(right)]
        lefts, rights = (s[np.argsort(-gain[s], kind="stable")] for s in sides)
        m = min(len(lefts), len(rights))
        swaps = int((gain[lefts[:m]] + gain[rights[:m]] > 1e-9).sum())
        if not swaps:
            break
        right[lefts[:swaps]], right[rights[:swaps]] = True, False
    return right, a, b


def bisected(graph: Graph, n: int, most: int = CLUSTER) -> list[np.ndarray]:
    """The n documents in clusters of at most `most`, in their new order."""
    out, todo = [], [np.arange(n)]
    while todo:
        docs = todo.pop()
        if len(docs) <= most:
            out.append(docs)
            continue
        places, terms = graph.edges(docs)
        right = halved(places, np.unique(terms, return_inverse=True)[1], len(docs))[0]
        todo += [docs[right], docs[~right]]
    return out


def fit(graph: Graph, n: int, terms: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the first levels every term's leaning to the right, and the limit from which a document goes right."""
    leaning, limits = np.zeros((2**top - 1, terms), np.float32), np.zeros(2**top - 1, np.float32)
    nodes = {0: np.arange(n)}
    for node in range(2**top - 1):
        docs = nodes.pop(node)
        if len(docs) > 1:
            places, t = graph.edges(docs)
            used, t = np.unique(t, return_inverse=True)
            _, a, b = halved(places, t, len(docs))
            leaning[node, used] = np.log2((b + 1) / (a + 1))
            value = np.bincount(places, weights=leaning[node, used][t], minlength=len(docs))
            limits[node] = np.median(value)
            docs = [docs[value < limits[node]], docs[value >= limits[node]]]
        else:
            docs = [docs, docs[:0]]
        nodes[2 * node + 1], nodes[2 * node + 2] = docs
    return leaning, limits


def _route(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaning, limits = model.value
        for batch in batches:
            n = batch.num_rows
            places, terms = Graph(batch.column("terms")).edges(np.arange(n))
            node = np.zeros(n, np.int64)
            while n and node[0] < len(limits):  # all stand on one level
                value = np.bincount(places, weights=leaning[node[places], terms], minlength=n)
                node = 2 * node + 1 + (value >= limits[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - len(limits), pa.int32())], [*batch.schema.names, "part"])

    return run


def _build(n_docs: int, n_terms: int):
    """A shard's clusters: INDEX. n_docs, n_terms: documents with terms, and all their terms."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        lists = shard["terms"].combine_chunks()
        graph, tf = Graph(lists), shard["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = 50 + 50 * shard["n"].to_numpy().astype(np.int64) * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(graph.ptr)))
        ids, base, rows = shard["doc_id"].combine_chunks(), int(shard["shard"][0].as_py()) << 20, []
        for k, docs in enumerate(bisected(graph, shard.num_rows)):
            places, terms = graph.edges(docs)
            sizes = graph.ptr[docs + 1] - graph.ptr[docs]
            ends = np.cumsum(sizes)
            at = np.repeat(graph.ptr[docs] - (ends - sizes), sizes) + np.arange(ends[-1])
            order = np.argsort(terms, kind="stable")
            used, first = np.unique(terms[order], return_index=True)
            impacts = impact[at][order]
            rows.append({
                "cluster": base | k, "ids": ids.take(pa.array(docs)).to_pylist(), "terms": used.astype(np.uint32).tobytes(), "ptr": np.append(first, len(order)).astype(np.uint32).tobytes(),
                "docs": places[order].astype(np.uint16).tobytes(), "impacts": impacts.astype(np.uint32).tobytes(), "peaks": np.maximum.reduceat(impacts, first).astype(np.uint32).tobytes(),
            })
        return pa.Table.from_pylist(rows, _INDEX)

    return run


_INDEX = pa.schema([("cluster", pa.int64()), ("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("terms", "ptr", "docs", "impacts", "peaks"))])


def _bounds(queries):
    """For each item and cluster the most that a document can score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, terms, weights = queries.value
        peak = np.zeros(len(weights), np.int64)
        for batch in batches:
            for cluster, used, peaks in zip(*(batch.column(k).to_pylist() for k in ("cluster", "terms", "peaks")), strict=True):
                used = np.frombuffer(used, np.uint32)
                peak[used] = np.frombuffer(peaks, np.uint32)
                bound = np.add.reduceat(peak[terms] * weights[terms], first[:-1])
                peak[used] = 0
                items = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(np.full(len(items), cluster), pa.int64()), pa.array(bound[items], pa.int64())], ["item", "cluster", "bound"])

    return run


def _score(queries, k: int):
    """The k best documents of a cluster for each item that visits it, at its threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, terms, weights = queries.value
        names = ("ids", "terms", "ptr", "docs", "impacts", "visits")
        for batch in batches:
            for ids, used, ptr, docs, impacts, visits in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                used, ptr, docs = np.frombuffer(used, np.uint32), np.frombuffer(ptr, np.uint32), np.frombuffer(docs, np.uint16)
                impacts = np.frombuffer(impacts, np.uint32).astype(np.int64)
                place = {t: i for i, t in enumerate(used.tolist())}
                none = np.array([x is None for x in ids])
                number = np.array([0 if x is None else x for x in ids], np.int64)
                for visit in visits:
                    i = visit["item"]
                    score = np.zeros(len(ids), np.int64)
                    for t in terms[first[i] : first[i + 1]].tolist():
                        if (p := place.get(t)) is not None:
                            a, b = ptr[p], ptr[p + 1]
                            score[docs[a:b]] += weights[t] * impacts[a:b]  # a document has a term once
                    good = np.flatnonzero(score >= max(1, visit["least"]))
                    good = good[np.lexsort((number[good], none[good], -score[good]))[:k]]
                    if len(good):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), i), pa.int32()), pa.array(number[good], pa.int64(), mask=none[good]), pa.array(score[good], pa.int64())], ["item", "doc_id", "score"])

    return run


def build_index(postings: DataFrame, vocabulary: int, n_docs: int, n_terms: int) -> DataFrame:
    """INDEX over the rows of postings (POSTINGS, written) that have a term of the vocabulary."""
    spark = postings.sparkSession
    some = postings.where(F.size("terms") > 0)
    sample = least_hashed(some.select("doc_id", "n", "terms"), FIT_ROWS, "doc_id", "n").select("terms").toArrow()["terms"].combine_chunks()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False)
    sample = sample.slice(0, int(np.searchsorted(np.cumsum(sizes), FIT_EDGES, side="right")))
    model = spark.sparkContext.broadcast(fit(Graph(sample), len(sample), vocabulary))
    routed = some.mapInArrow(_route(model), f"{POSTINGS}, part int")
    counts = {r.part: max(-(-r.rows // SHARD), -(-r.edges // SHARD_EDGES)) for r in routed.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.size("terms")).alias("edges")).collect()}
    salts = F.array(*[F.lit(counts.get(p, 1)) for p in range(2**TOP)])
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(salts, F.col("part") + 1))
    sharded = routed.withColumn("shard", F.col("part") * max(counts.values(), default=1) + salt)
    return saved(sharded.groupBy("shard").applyInArrow(_build(n_docs, n_terms), INDEX))


def _search(docs: DataFrame, rows: list, item_type: str, k: int, trace: list | None) -> DataFrame:
    spark = docs.sparkSession
    items = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r[1]) for r in rows}))}
    number = {x: i for i, x in enumerate(items)}
    asked = sorted((number[r[0]], vocabulary[bytes(r[1])]) for r in rows)
    postings = saved(docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), POSTINGS))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many as query terms
        df[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    first = np.searchsorted([a for a, _ in asked], np.arange(len(items) + 1))
    queries = spark.sparkContext.broadcast((first, np.array([t for _, t in asked], np.int64), weights))
    index = build_index(postings, len(vocabulary), n_docs, n_terms)
    left = saved(index.select("cluster", "terms", "peaks").mapInArrow(_bounds(queries), "item int, cluster long, bound long").withColumn("least", F.lit(1).cast("long")))
    best, width = None, FIRST
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "cluster"))
        chosen = saved(left.withColumn("place", place).where(F.col("place") <= width).drop("place"))
        if trace is not None:
            trace.append((chosen.count(), left.count()))
        visits = chosen.groupBy("cluster").agg(F.collect_list(F.struct("item", "least")).alias("visits"))  # the block's items at most
        found = index.drop("peaks").join(visits, "cluster").drop("cluster").mapInArrow(_score(queries, k), "item int, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = saved((found if best is None else best.drop("rank").unionByName(found)).withColumn("rank", rank).where(F.col("rank") <= k))
        full = best.where(F.col("rank") == k).select("item", F.col("score").alias("__least"))
        left = left.join(chosen.select("item", "cluster"), ["item", "cluster"], "left_anti").join(full, "item", "left")
        left = saved(left.withColumn("least", F.greatest("least", F.coalesce("__least", F.lit(1)))).drop("__least").where("bound >= least"))
        width *= 8
    if best is None:
        best = spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"item int, item_id {item_type}")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, trace: list | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of docs(doc_id, text) for each item(item_id, text).

    trace: gets, wave by wave, the pairs of item and cluster that were visited, and those left before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_query_terms, f"item_id {kind}, term binary").distinct()
    terms = saved(terms)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0) // query_bytes))
    out = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        part = _search(docs, rows, kind, k, trace) if rows else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
i AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms)) AS impact FROM t JOIN d USING (r), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN f USING (term) GROUP BY ALL),
y AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM y WHERE rank <= 50
"""
