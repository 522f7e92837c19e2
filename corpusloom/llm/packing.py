"""Best-fit packing: token pieces go into as few sequences of at most 4096 tokens as can be.

The plan needs the length histogram only (4096 counts, however large the corpus). Its configuration linear program - a
configuration is a set of lengths that fits, each length must be covered as often as it occurs - is solved by
multiplicative weights: a length's weight falls as it gets covered, and the next configurations are those of most weight, by
a knapsack table over the capacity (one table prices many configurations: the best with each length in it). The
fractional solution is rounded to whole sequences, at first only to those that are full to the last token; the program is
solved again for what is left, and so on, with wider gaps only when rounding stalls. The few pieces that remain go
best-fit, longest first, into the gaps and into new sequences.

The pieces then take the plan's places: each piece gets its rank within its length and looks up the place of that rank.
Ranks are counted in salted groups, so no length, however frequent, meets in one task.

Cases: a null text is empty and has the end id only. Repeated rows are packed each. A null doc_id is kept. Ties are
broken by doc_id and piece; rows equal in both are interchangeable. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, read_table, saved, small_batches, steps

CAPACITY, END_ID = 4096, 1
#: Lengths are rounded up to multiples of it in the linear program; sequences are made of true lengths.
GRAIN = 4
#: How sharply a length's weight falls as it gets covered.
ETA = 0.1
#: Rounding stalls if more than this share of the pieces is left.
STALL = 0.85
PIECE = "doc_id long, piece int, start long, length int, ids binary"

_encoders: dict = {}
#: Stands between words that are encoded together.
MARK = b"\x01"
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 1_000_000


class Encoder(dict):
    """Token ids of words as little-endian bytes. The tokenizer drops white space and never joins across it, so the ids of
    a text are those of its words (split at ASCII blanks) in a row."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words not yet known, many in one text with MARK between them. No word holds MARK's byte, so its ids
        can't come from a word; words that do hold it are encoded alone."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        plain = [w for w in new if MARK not in w]
        mark = np.array(self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids)
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            text = b" ".join(x for w in some for x in (w, MARK)).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == mark[0])
            assert len(mark) == 1 and len(ends) == len(some)
            line, last = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                self[word] = line[last:end]
                last = end + 4
        for word in new:
            if MARK in word:
                self[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, end: int):
    tail = np.array([end], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in steps(batches):
            lists = [t.split() if t else [] for t in as_bytes(batch.column("text"))]
            known.learn(set().union(*lists))
            out: list[tuple] = []
            for doc, words in zip(batch.column("doc_id").to_pylist(), lists, strict=True):
                ids = b"".join(map(known.__getitem__, words)) + tail
                out += [(doc, k, k * capacity, len(x) // 4, x) for k in range(-(-len(ids) // (4 * capacity))) if (x := ids[4 * capacity * k : 4 * capacity * (k + 1)])]
            cols, kinds = zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """PIECE for every piece of every document: its ids (little-endian, 4 bytes each), the end id after the last."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), PIECE)


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity the length to take first towards the most total value (repeats allowed), or 0 to leave one free.

    value[l] is that of length l; a length of no value is never taken.
    """
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # best stands in reverse
    for c in range(1, capacity + 1):
        gain = best[capacity - c + 1 :] + value[1 : c + 1]
        k = int(gain.argmax())
        if gain[k] > best[capacity - c + 1]:
            best[capacity - c], took[c] = gain[k], k + 1
        else:
            best[capacity - c] = best[capacity - c + 1]
    return took


def configuration(took: np.ndarray, first: int, capacity: int) -> list[int]:
    """The best configuration that has the length `first`."""
    out, c = [first], capacity - first
    while c > 0:
        if took[c]:
            out.append(int(took[c]))
        c -= max(int(took[c]), 1)
    return out


def solve(counts: np.ndarray, capacity: int, eta: float = ETA) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations, as (length, how often) pairs, with fractional multiplicities that cover counts[l] of each length l."""
    need = counts.astype(float)
    covered = np.where(need > 0, 0.0, 1.0)
    found: dict[tuple, float] = defaultdict(float)
    while len(short := np.flatnonzero(covered < 1)):
        weight = np.exp(-eta * (covered[short] - covered[short].min()))
        value = np.zeros(len(need))
        value[short] = short * weight
        took = knapsack(value, capacity)
        for first in short[np.lexsort((-short, covered[short]))].tolist():  # the least covered first
            lengths, times = np.unique(configuration(took, first, capacity), return_counts=True)
            if (covered[lengths] >= 1).any():  # the table knew less than is covered by now
                continue
            each = (1 - covered[lengths]) * need[lengths] / times
            amount = float(each.min())
            covered[lengths] += amount * times / need[lengths]
            covered[lengths[each <= amount * (1 + 1e-9)]] = 1.0
            found[tuple(zip(lengths.tolist(), times.tolist(), strict=True))] += amount
    return found


def sequences(left: np.ndarray, classes: list[int], times: int, gap: int, capacity: int, grain: int) -> list[tuple[list[int], int]]:
    """Up to `times` whole sequences of a configuration, with at most `gap` tokens free; they are taken from left.

    A class k holds the lengths from (k - 1) * grain + 1 to k * grain. The two shortest are chosen together, to fill what is
    free; the last may be longer than its class.
    """

    def longest(use: dict[int, int], most: int, k: int) -> int:
        return next((x for x in range(min(most, capacity), (k - 1) * grain, -1) if left[x] > use.get(x, 0)), 0)

    out: list[tuple[list[int], int]] = []
    while times > 0:
        use: dict[int, int] = defaultdict(int)
        room = capacity
        for k in classes[:-2]:
            if not (x := longest(use, k * grain, k)):
                return out
            use[x] += 1
            room -= x
        pick: tuple[int, ...] = ()
        if len(classes) > 1:
            for x in range(min(classes[-2] * grain, room), (classes[-2] - 1) * grain, -1):
                if left[x] > use.get(x, 0) and (y := longest(use | {x: use.get(x, 0) + 1}, room - x, classes[-1])) and x + y > sum(pick):
                    pick = (x, y)
        elif x := longest(use, room, classes[-1]):
            pick = (x,)
        if not pick or room - sum(pick) > gap:
            return out
        for x in pick:
            use[x] += 1
        many = min(times, *(int(left[x]) // n for x, n in use.items()))
        for x, n in use.items():
            left[x] -= many * n
        out.append(([x for x, n in use.items() for _ in range(n)], many))
        times -= many
    return out


def rounded(counts: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """(sequences rounded from the linear program as (lengths, number), counts of what is left)."""
    left, bins, gap = counts.copy(), [], 0
    while before := int(left.sum()):
        coarse = np.zeros(capacity // grain + 1, np.int64)
        np.add.at(coarse, -(-np.arange(len(left)) // grain), left)
        for config, amount in sorted(solve(coarse, capacity // grain).items(), key=lambda x: -x[1]):
            classes = sorted((k for k, n in config for _ in range(n)), reverse=True)
            bins += sequences(left, classes, int(amount + 0.5), gap, capacity, grain)
        if left.sum() > STALL * before:
            if gap >= capacity // 100:
                break
            gap = max(grain, 4 * gap)
    return bins, left


def pack_plan(counts: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), using up counts[l] pieces of each length l exactly."""
    bins, left = rounded(counts, capacity, grain)
    return best_fit(left, bins, capacity)


def best_fit(left: np.ndarray, bins: list[tuple[list[int], int]], capacity: int) -> list[tuple[list[int], int]]:
    """Places what is left, longest first, each length into the fullest sequences that have room, many at a time."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    open_ = np.zeros(capacity + 1, bool)
    for lengths, many in bins:
        room[capacity - sum(lengths)].append((lengths, many))
    for r in room:
        open_[r] = True
    for x in range(len(left) - 1, 0, -1):
        count = int(left[x])
        while count:
            spots = np.flatnonzero(open_[x:])
            if len(spots):
                r = x + int(spots[0])
                lengths, many = room[r].pop()
                now = min(many, count)
                if many > now:
                    room[r].append((lengths, many - now))
                open_[r] = bool(room[r])
                room[r - x].append(([*lengths, x], now))
                open_[r - x] = True
                count -= now
            else:
                each = capacity // x
                for per, many in ((each, count // each), (count % each, 1)):
                    if per and many:
                        room[capacity - per * x].append(([x] * per, many))
                        open_[capacity - per * x] = True
                count = 0
    return [b for some in room.values() for b in some]


def place_table(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For ranks within a length: sorted keys (length and first rank) with sequence, pieces a sequence, and offset."""
    rows, base, used = [], 0, defaultdict(int)
    for lengths, many in plan:
        at = 0
        for x, n in sorted(((x, lengths.count(x)) for x in set(lengths)), reverse=True):
            rows.append((x << 44 | used[x], base, n, at))
            used[x] += n * many
            at += n * x
        base += many
    rows.sort()
    names = ("key", "base", "each", "at")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 4).T.copy(), strict=True))


def _places(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            key = length << 44 | rank
            i = np.searchsorted(t["key"], key, side="right") - 1
            k = key - t["key"][i]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(t["base"][i] + k // t["each"][i]), pa.array(t["at"][i] + k % t["each"][i] * length)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset. pieces is read three times: save it first."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    shared = pieces.sparkSession.sparkContext.broadcast(place_table(pack_plan(counts, capacity)))
    salts = 16 + int(counts.sum()) // 20_000
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "salt"]).select(*pieces.columns, (F.col("before") + F.col("place") - 1).alias("rank"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id long", "offset long"])
    return ranked.mapInArrow(_places(shared), schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The query's columns: each piece's tokens as a checksum, and its place."""
    pieces = token_pieces(docs, vocabulary_path())
    pieces = saved(pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32")))
    return pack(pieces)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))
