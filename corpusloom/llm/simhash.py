"""SimHash near-duplicate groups: fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Search by the generalised pigeonhole principle. Bits that go together over the corpus are grouped into one part, so that
the parts are as independent as can be. If two fingerprints differ in at most r bits and the parts have thresholds
t_1, t_2, ... (-1: unused) with sum(t_i + 1) = r + 1, some part differs in at most t_i bits. Dynamic programming picks
the thresholds with the fewest expected probes and candidates. Each fingerprint is stored under its value in a part and
probes all values within that part's threshold; candidates are verified on all 64 bits.

A bucket with over MOST fingerprints isn't paired off, as its pairs grow with its square. Its fingerprints, and those that
probe it, meet at points instead: one of even parity goes to its own value and to all values two flips away, one of odd
parity to all values one flip away. At a point all link to one fingerprint that is odd, or the point itself. Two
fingerprints at distance 1, 2 or 3 share a point where one of them may be that one, and no such link exceeds 3 bits, so
the same components come out exactly, from a number of rows that is a multiple of the fingerprints.

Cases: a null text, or one with no word, has fingerprint zero and links like any other; fewer than 3 words are one
shingle. All joins are merges: the tables grow with the corpus, so none may go to the driver for a broadcast. Repeated rows get equal rows. A null doc_id takes part, but never names a component (unless all are null). An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, least_hashed, read_table, saved, small_batches, steps
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that are compared pair by pair.
MOST = 48
#: Shares in which a fingerprint's points are dealt to tasks.
CHUNKS = 16
#: Fingerprints from which the expected candidates of a threshold are estimated; this steers cost, never the result.
SAMPLE = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> list[bytes]:
    """XXH64 of every shingle, as 8 bytes, the highest first."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly the six blanks of ASCII
    if not words:
        return []
    line, h = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return [h(line, SEED)]
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n, initial=-1))
    return [h(line[a + 1 : b], SEED) for a, b in zip(ends, ends[width:], strict=False)]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """A signed 64-bit fingerprint for each text."""
    lists = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(x) for x in lists])
    octets = np.frombuffer(b"".join(map(b"".join, lists)), np.uint8).reshape(-1, 8)
    owner, ones = np.repeat(np.arange(len(texts), dtype=np.int64) * 256, sizes), np.empty((len(texts), 64))
    for k in range(8):
        counts = np.bincount(owner + octets[:, 7 - k], minlength=256 * len(texts)).reshape(-1, 256)
        ones[:, 8 * k : 8 * k + 8] = counts @ _BITS  # exact: sums of whole numbers below 2^53
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(as_bytes(batch.column("text"))))], ["doc_id", "fp"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        x = _bits(np.ascontiguousarray(batch.column("fp").to_numpy())).astype(np.float32) * 2 - 1
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["cell", "sum"])


def group_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in so many parts, each grown by the bit that goes best with those it has."""
    strength = np.abs(together).astype(float)
    np.fill_diagonal(strength, 0)
    free, out = set(range(64)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        seed = max(free, key=lambda b: (strength[b, list(free)].sum(), -b))
        part = [seed]
        free.remove(seed)
        while len(part) < size:
            nxt = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(nxt)
            free.remove(nxt)
        out.append(sorted(part))
    return out


def allocate(parts: list[list[int]], count: int, near: np.ndarray, radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds of least expected cost. near[i, t]: share of pairs within t bits in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, bits in enumerate(parts):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, radius + 1 - used):
                probes = sum(len(list(combinations(range(len(bits)), k))) for k in range(t + 1)) if t < 3 else 64**3 / 6
                more = cost + (0 if t < 0 else 2 * count * probes + count * count / 2 * near[i, t])
                key = used + t + 1
                if key not in step or more < step[key][0]:
                    step[key] = (more, [*chosen, t])
        best = step
    return best[radius + 1]


def plan(distinct: DataFrame, count: int) -> list[tuple[list[int], int]]:
    """The parts in use, each with its threshold."""
    sums = distinct.mapInArrow(_together, "cell long, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).collect()
    together = np.zeros(4096)
    for r in sums:
        together[r["cell"]] = r["sum"]
    some = np.array([r[0] for r in least_hashed(distinct, SAMPLE, "fp", count=count).collect()], np.int64)
    bits, options = _bits(some).astype(np.float32), []
    for n in (2, 3, 4):
        parts = group_bits(together.reshape(64, 64), n)
        near = np.zeros((n, RADIUS + 1))
        for i, part in enumerate(parts):
            x = bits[:, part]
            gap = x @ (1 - x.T)
            gap = (gap + gap.T)[np.triu_indices(len(x), 1)]
            for t in range(RADIUS + 1):
                ball = sum(len(list(combinations(range(len(part)), k))) for k in range(t + 1))
                near[i, t] = max((gap <= t).mean() if len(gap) else 0, ball / 2.0 ** len(part))
        cost, chosen = allocate(parts, count, near)
        options.append((cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _flips(bits: list[int], most: int) -> np.ndarray:
    """Masks with up to `most` of the bits set, those with fewer first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64).view(np.int64)


def _probes(parts: list[tuple[list[int], int]]):
    """Rows (part, key, flips, fp) for every probe of every fingerprint; flips 0 is its own bucket."""
    made = [(_mask(bits), _flips(bits, t)) for bits, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for i, (mask, flips) in enumerate(made):
                key = ((fp & mask)[:, None] ^ flips[None, :]).ravel()
                count = np.tile(_bits(flips).sum(axis=1).astype(np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), pa.array(count), pa.array(np.repeat(fp, len(flips)))], ["part", "key", "flips", "fp"])

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (point, fp, centre): the share `chunk` of the fingerprint's points, all of them of even parity.

    Even fingerprints go to themselves and to what is two flips away, odd ones to what is one flip away.
    """
    flips = _flips(list(range(64)), 2)
    size = _bits(flips).sum(axis=1)
    near, far = flips[size == 1], flips[size != 1]
    for batch in batches:
        fp, chunk = batch.column("fp").to_numpy(), batch.column("chunk").to_numpy()
        odd = _bits(fp).sum(axis=1) % 2 == 1
        for k in range(CHUNKS):
            for parity, reach in ((True, near[k::CHUNKS]), (False, far[k::CHUNKS])):
                mine = fp[(odd == parity) & (chunk == k)]
                for at in range(0, len(mine), 500):
                    some = mine[at : at + 500]
                    point = (some[:, None] ^ reach[None, :]).ravel()
                    centre = np.tile(np.full(len(reach), True) if parity else reach == 0, len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(np.repeat(some, len(reach))), pa.array(centre)], ["point", "fp", "centre"])


def links(distinct: DataFrame, count: int, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all pairs at RADIUS or fewer bits."""
    parts = plan(distinct, count)
    probes = distinct.mapInArrow(_probes(parts), "part int, key long, flips int, fp long")
    own: Column = F.when(F.lit(False), 0)
    for i, (bits, _) in enumerate(parts):
        own = own.when(F.col("part") == i, F.col("fp").bitwiseAND(F.lit(_mask(bits))))
    index = distinct.select(F.explode(F.array(*[F.lit(i) for i in range(len(parts))])).alias("part"), "fp").select("part", own.alias("key"), F.col("fp").alias("other"))
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("size"))
    live = saved(probes.join(sizes.hint("merge"), ["part", "key"]).where("size > 1 or flips > 0"))
    close = live.where(F.col("size") <= most).join(index.hint("merge"), ["part", "key"]).where("fp < other").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
    crowded = live.where(F.col("size") > most).select("fp").distinct()
    dealt = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk")).repartition("fp", "chunk")
    points = dealt.mapInArrow(_points, "point long, fp long, centre boolean")
    centres = points.where("centre").groupBy("point").agg(F.min("fp").alias("other"))
    starred = points.select("point", "fp").join(centres.hint("merge"), "point").where("fp != other")
    return close.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(starred.select(F.col("fp").alias("a"), F.col("other").alias("b"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for each row of docs."""
    marked = saved(with_fingerprint(docs))
    firsts = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    distinct = firsts.select("fp")
    nodes = components(links(distinct, distinct.count()))
    grouped = firsts.join(nodes.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(grouped.join(heads.hint("merge"), "root").select("fp", "component_id"))
    return marked.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that are the first of their group (all rows of that doc_id). Rows with a null
    doc_id stay: they name no group."""
    dropped = near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)
