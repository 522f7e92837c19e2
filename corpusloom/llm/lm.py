"""LM scoring by logistic context mixing over bits, beside a word-unigram score.

Model. A text is scored in the form that the unigram score sees: A-Z lower-cased, its words (split at ASCII blanks) joined
by one blank each, as UTF-8 bytes, and a zero byte at its end. Each bit of a byte has five predictions, one from each
context of the 1 to 5 bytes before it (with the byte's bits so far), read from hashed tables of how often the bit was 1.
The predictions, as log odds, are mixed by weights chosen by a gate (the longest context with evidence, and the bit's
number), and the result is refined by an adaptive table over (bits so far, log odds). A text's cost is the sum over its
bits; score is its log10 probability, bits_per_byte its cost per byte.

Learning. All training texts count: every 6-byte run is counted over the corpus by Spark, in a table that grows with the
corpus. Nothing is hashed: the counts of a context's bits are sums over the runs that end in it, so each is exact. The runs
are dealt by the 3 bytes before the last one, so all runs of a context of 3 to 5 bytes meet in one task; the counts of
1 and 2 bytes (at most 2^24 by definition) travel. Weights and the adaptive table are learned online, in one pass over the
counted runs, where each run's own occurrence is taken out of the counts first; eight learners or more (one for every SHARE
distinct runs) work on a share of the runs each, and their results are averaged by weight.

Recurring words. Before a word there may be one bit more: whether it is the word that a longer context foretells. The context
is the hash of the two words before (64 bits, in a table that grows with the corpus), kept for one in ANCHORS of them, with
the words that follow it: as far as all its occurrences agree, AHEAD at most. Words are compared by 16 bits of their hash, so one other
word in 65,536 passes for the one foretold. The bit's probability comes from an adaptive table over its state: how often the
context came, whether the word before was foretold too, and how many were foretold rightly in a row. That table is learned on
training texts that the contexts leave out (one in LEFT_OUT), so it knows how often what is foretold is wrong. A word
foretold costs that bit only, any other the bit and its bytes. A text that is counted in the contexts is not counted for itself: its own
occurrence is taken out of a context's number. So copies and stock passages cost little, by their real evidence.

Scoring. Each distinct run of the texts is priced once; the prices meet the runs of each block of texts (ROWS rows of a file)
in a join, and go to the block's texts. Nothing is learned then, so a score depends on the text and the training texts only.

The unigram score needs the count of every word. The frequent words (at most TOP of them) travel to the tasks; the rest of
each text's words meet the vocabulary in a join, whose keys are all infrequent, so no key is hot.

Cases: a null text is empty: it has the end only. With no training text all counts are 0. A null
doc_id is never held out, and learned from like any other. Repeated rows get equal rows. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, as_bytes, mix, pieces, read_table, release, saved, small_batches, steps

ORDERS = 5
#: Learners at least, distinct runs from which there are more, gates, places of the adaptive table along the log odds.
LEARNERS, SHARE, GATES, PLACES = 8, 1 << 24, (ORDERS + 1) * 8, 33
#: How much a context is drawn towards the shorter one, in occurrences, and from how many it counts as known.
PRIOR, KNOWN = 0.4, 2
RATE, BATCH = 0.1, 1000
#: Words whose counts travel to every task.
TOP = 150_000
#: Words or runs that a task holds before it hands on their counts.
HELD = 200_000
#: One context of two words in so many is kept, with up to so many words after it; states: words foretold in a row, count.
ANCHORS, AHEAD, ROWED, COUNTED, LEFT_OUT = 16, 12, 8, 4, 8
#: What follows a context, as whole numbers: four words in each.
AFTER = tuple(f"a{i}" for i in range(AHEAD // 4))
#: Rows of a file whose texts get their prices together; runs of a block that a task holds, and more that it adds up at once; runs
#: whose contexts are read together, and of which the nodes are held at once (a multiple of BATCH).
ROWS, KEPT, ADDED, CHUNK, PART = 32_768, 1_500_000, 1_000_000, 100_000, 20_000


def plain(text: bytes | None) -> bytes:
    return b" ".join(text.lower().split()) if text else b""


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 48-bit number for each byte and end: the 5 bytes before it and itself; how many for each text)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    b = np.frombuffer(b"".join(x for t in texts for x in (b"\0" * ORDERS, t, b"\0")), np.uint8).astype(np.uint64)
    if not len(b):
        return np.empty(0, np.uint64), sizes
    n = len(b) - ORDERS
    out = np.zeros(n, np.uint64)
    for k in range(ORDERS + 1):
        out = out << np.uint64(8) | b[k : k + n]
    starts = np.cumsum(sizes + ORDERS) - (sizes + ORDERS)
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return out[at], sizes


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys in order, the sum of n of each)."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def level(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order k's counts, from those of longer runs: (context and byte in order, counts up to each)."""
    keys, n = summed(keys & np.uint64((1 << 8 * (k + 1)) - 1), n)
    return keys, np.concatenate([[0], np.cumsum(n)])


def nodes(levels: list[tuple[np.ndarray, np.ndarray]], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit of the runs' last bytes was met, and was 1, in each order's context: two arrays (8, runs, ORDERS)."""
    seen, ones = np.empty((8, len(runs), ORDERS), np.float32), np.empty((8, len(runs), ORDERS), np.float32)
    for k, (keys, upto) in enumerate(levels, 1):
        own = runs & np.uint64((1 << 8 * (k + 1)) - 1)
        order = np.argsort(own)
        own = own[order]
        to = lambda at: upto[np.searchsorted(keys, at)]  # noqa: B023, E731
        low = own & ~np.uint64(255)
        below, above = to(low), to(low + np.uint64(256))
        for j in range(8):
            half = to(low + np.uint64(128 >> j))
            seen[j, order, k - 1], ones[j, order, k - 1] = above - below, above - half
            bit = (own >> np.uint64(7 - j) & np.uint64(1)) > 0
            below, above = np.where(bit, half, below), np.where(bit, above, half)
            low = low + np.where(bit, np.uint64(128 >> j), np.uint64(0))
    return seen, ones


def bits_of(runs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bit of the last byte: (its number, the byte's bits so far, the bit)."""
    last = (runs & np.uint64(255)).astype(np.int32)
    for j in range(8):
        yield j, last >> (8 - j) | 1 << j, (last >> (7 - j) & 1).astype(np.float32)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Mixer:
    """low: the counts of order 1 and 2 (see level); weights: (GATES, ORDERS + 1); refine: (256, PLACES) log odds; runs: the
    table of counted runs, on the driver only."""

    low: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    refine: np.ndarray
    runs: DataFrame | None = None

    @classmethod
    def fresh(cls, low: list[tuple[np.ndarray, np.ndarray]]) -> Mixer:
        grid = np.tile(np.linspace(-8, 8, PLACES, dtype=np.float32), (256, 1))
        return cls(low, np.tile(np.float32([0] * (ORDERS - 2) + [0.3, 0.7, 0]), (GATES, 1)), grid)

    def levels(self, runs: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """runs: all counted runs with the 3-byte contexts in question."""
        return [*self.low, *(level(runs, n, k) for k in range(3, ORDERS + 1))]

    def inputs(self, j: int, n: np.ndarray, n1: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each order and 1; the gate). own: the bit to take out of the counts."""
        if own is not None:
            n, n1 = np.maximum(n - 1, 0), np.maximum(n1 - own[:, None], 0)
        x = np.ones((len(n), ORDERS + 1), np.float32)
        p = np.full(len(n), 0.5, np.float32)
        for k in range(ORDERS):  # each context's share, drawn towards that of the shorter one
            p = np.clip((n1[:, k] + PRIOR * p) / (np.maximum(n[:, k], n1[:, k]) + PRIOR), 1e-6, 1 - 1e-6)
            x[:, k] = np.log(p / (1 - p))
        known = n >= KNOWN
        longest = np.where(known.any(axis=1), ORDERS - np.argmax(known[:, ::-1], axis=1), 0)
        return x, longest * 8 + j

    def refined(self, so_far: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(final probability of a 1, lower place, share of the upper place)."""
        at = (np.clip(mixed, -7.999, 7.999) + 8) * ((PLACES - 1) / 16)
        low = at.astype(np.int32)
        share = at - low
        fine = self.refine[so_far, low] * (1 - share) + self.refine[so_far, low + 1] * share
        return np.clip((_squash(mixed) + _squash(fine)) / 2, 1e-6, 1 - 1e-6), low, share

    def price(self, runs: np.ndarray, seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's last byte, from its nodes."""
        total = np.zeros(len(runs))
        for j, so_far, bit in bits_of(runs):
            x, gate = self.inputs(j, seen[j], ones[j], None)
            p, _, _ = self.refined(so_far, (x * self.weights[gate]).sum(axis=1))
            total += np.log10(np.where(bit > 0, p, 1 - p))
        return total

    def cost(self, runs: np.ndarray) -> np.ndarray:
        """The same of a few runs, on the driver: it fetches the counts that they need."""
        context = [int(c) for c in np.unique(runs >> np.uint64(8) & np.uint64(0xFFFFFF))]
        rows = self.runs.where(_context().isin(context)).toArrow()
        return self.price(runs, *nodes(self.levels(rows["run"].to_numpy().astype(np.uint64), rows["n"].to_numpy()), runs))

    def learn(self, runs: np.ndarray, counts: np.ndarray, seen: np.ndarray, ones: np.ndarray) -> None:
        """Online: one step for each batch of runs, first of the weights, then of the adaptive table."""
        weight = counts.astype(np.float32)
        for j, so_far, bit in bits_of(runs):
            x, gate = self.inputs(j, seen[j], ones[j], bit)
            mixed = (x * self.weights[gate]).sum(axis=1)
            error = (bit - _squash(mixed)) * weight
            mass = np.maximum(np.bincount(gate, weights=weight, minlength=GATES), 1)
            for k in range(ORDERS + 1):
                self.weights[:, k] += RATE * np.bincount(gate, weights=error * x[:, k], minlength=GATES) / mass
            _, low, share = self.refined(so_far, mixed)
            fine = self.refine[so_far, low] * (1 - share) + self.refine[so_far, low + 1] * share
            error = (bit - _squash(fine)) * weight
            for side, part in ((low, 1 - share), (low + 1, share)):
                cell = so_far * PLACES + side
                up, of = (np.bincount(cell, weights=v, minlength=256 * PLACES) for v in (error * part, part * weight))
                self.refine += (0.5 * up / (of + 4)).reshape(256, PLACES).astype(np.float32)


_P = 0x9E3779B97F4A7C15
_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    if base not in _made or len(_made[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _made[base] = np.cumprod(factors)
    return _made[base][:n]


@dataclass
class Words:
    """The words of some texts: whose they are, where their bytes begin, short hashes, and the contexts that are kept."""

    owner: np.ndarray
    starts: np.ndarray
    short: np.ndarray
    anchors: np.ndarray  # the words before which a kept context stands
    contexts: np.ndarray
    lengths: np.ndarray  # words up to the next kept context, AHEAD at most

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        """texts as plain() makes them. A word's hash takes in the blank or the end that follows it, so a text's last word is
        another word than elsewhere."""
        b = np.frombuffer(b"".join(x for t in texts for x in (t, b"\0")), np.uint8)
        ends = np.flatnonzero((b == 32) | (b == 0))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        last = b[ends] == 0
        owner = np.cumsum(last) - last
        with np.errstate(over="ignore"):
            upto = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * _powers(_P, len(b)))])
            h = mix((upto[ends + 1] - upto[starts]) * _powers(pow(_P, -1, 1 << 64), len(b))[starts])
        first = np.concatenate([[True], last[:-1]]) if len(ends) else last
        before = np.where(first, np.uint64(7), np.concatenate([h[:1], h[:-1]]))
        two = np.where(first, np.uint64(9), np.concatenate([before[:1], before[:-1]]))
        with np.errstate(over="ignore"):
            context = mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + two * np.uint64(0x165667B19E3779F9))
        at = np.flatnonzero(context % np.uint64(ANCHORS) == 0)
        behind = np.flatnonzero(last)[owner[at]] + 1
        lengths = np.minimum(np.minimum(np.append(at[1:], len(h)), behind) - at, AHEAD) if len(at) else at
        return cls(owner, starts, np.maximum(h & np.uint64(0xFFFF), np.uint64(1)), at, context[at].view(np.int64), lengths)

    def after(self) -> np.ndarray:
        """What follows each kept context: a column for each of AFTER; 16 bits a word, the first in the highest, 0 for none."""
        out = np.zeros((len(self.anchors), len(AFTER)), np.uint64)
        for k in range(AHEAD):
            some = np.flatnonzero(k < self.lengths)
            out[some, k // 4] |= self.short[self.anchors[some] + k] << np.uint64(48 - 16 * (k % 4))
        return out.view(np.int64)


class Foretold:
    """A block's kept contexts: how often they came, and the words that follow them wherever they came."""

    def __init__(self, table: np.ndarray) -> None:
        """table: a row for each context, with its hash, number, agreed words and AFTER; rows may come again."""
        self.contexts, first = np.unique(table[:, 0], return_index=True)
        self.n, self.size, after = table[first, 1], table[first, 2], table[first, 3:].view(np.uint64)
        self.after = np.stack([after[:, k // 4] >> np.uint64(48 - 16 * (k % 4)) & np.uint64(0xFFFF) for k in range(AHEAD)], axis=1)

    def states(self, words: Words, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its state (-1: nothing is foretold) and whether it is the word foretold. counted: texts in the table."""
        state, hit = np.full(len(words.short), -1), np.zeros(len(words.short), bool)
        if not len(self.contexts) or not len(words.anchors):
            return state, hit
        row = np.minimum(np.searchsorted(self.contexts, words.contexts), len(self.contexts) - 1)
        found = np.flatnonzero(self.contexts[row] == words.contexts)
        row, at, most = row[found], words.anchors[found], np.minimum(words.lengths[found], self.size[row[found]])
        n = self.n[row] - counted[words.owner[at]]
        going = n > 0
        for k in range(AHEAD):
            going = going & (k < most)
            spot = at[going] + k
            right = self.after[row[going], k] == words.short[spot]
            state[spot], hit[spot] = np.clip(n[going], 1, COUNTED) - 1 + (COUNTED if k else 0), right
            going[going] = right
        told = np.flatnonzero(state >= 0)
        place = np.arange(len(told))
        new = np.ones(len(told), bool)
        new[1:] = (words.owner[told[1:]] != words.owner[told[:-1]]) | ~hit[told[:-1]]
        row_of = place - np.maximum.accumulate(np.where(new, place, 0))  # foretold rightly since a miss or the text's beginning
        state[told] += np.minimum(row_of, ROWED - 1) * 2 * COUNTED
        return state, hit


STATES = ROWED * 2 * COUNTED


class Prices:
    """The price of each of a block's runs, in hash tables: what finds its place taken goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray) -> None:
        self.tables = []
        keys, first = np.unique(keys, return_index=True)
        costs = costs[first]
        while len(keys):
            bits = max(4, int(2 * len(keys)).bit_length())
            at = self._place(keys, bits, len(self.tables))
            have, price = np.full(1 << bits, 1 << 63, np.uint64), np.zeros(1 << bits, np.float32)
            have[at] = keys
            rest = have[at] != keys
            price[at[~rest]] = costs[~rest]
            self.tables.append((bits, have, price))
            keys, costs = keys[rest], costs[rest]

    @staticmethod
    def _place(keys: np.ndarray, bits: int, depth: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            odd = np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2E) * np.uint64(depth)
            return (keys * odd >> np.uint64(64 - bits)).astype(np.int64)

    def cost(self, runs: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(runs)), np.arange(len(runs))
        for depth, (bits, have, price) in enumerate(self.tables):
            at = self._place(runs[left], bits, depth)
            hit = have[at] == runs[left]
            out[left[hit]] = price[at[hit]]
            left = left[~hit]
        if len(left):
            raise RuntimeError(f"{len(left)} runs of a block have no price")
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    for batch in steps(batches):
        for text in as_bytes(batch.column("text")):
            held.update(text.lower().split() if text else ())
        held[b""] += batch.num_rows  # the end
        if len(held) > HELD:
            yield emit()
            held.clear()
    if held:
        yield emit()


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each block, and how often each is in texts that are learned from."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block, added = None, 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        both, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return summed(both, counts)

    def emit() -> Iterator[pa.RecordBatch]:
        both, counts = taken()
        runs, n = summed(both >> np.uint64(1), counts * (both & np.uint64(1)).astype(np.int64))
        for at in range(0, len(runs), CHUNK):
            some = runs[at : at + CHUNK].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block, np.int64)), pa.array(some), pa.array(n[at : at + CHUNK])], ["block", "run", "n"])

    for batch in steps(batches, most=PIECE_BYTES):
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if held and blocks[at] != block:
                yield from emit()
                added = 0
            block, part = blocks[at], batch.slice(at, to - at)
            runs, sizes = runs_of([plain(t) for t in as_bytes(part.column("text"))])
            learned = np.repeat(part.column("learned").to_numpy(zero_copy_only=False).astype(np.uint64), sizes)
            held.append(np.unique(runs << np.uint64(1) | learned, return_counts=True))
            added += len(held[-1][0])
            if added > ADDED:
                held.append(taken())
                added = 0
                if len(held[0][0]) > KEPT:
                    yield from emit()
    if held:
        yield from emit()


def _block_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept contexts of each block: n times in texts that are counted, u times in others; and the least and greatest of what
    follows them where it is counted."""
    for batch in steps(batches):
        met = []
        for piece in pieces(batch):
            words = Words.of([plain(t) for t in as_bytes(piece.column("text"))])
            of = words.owner[words.anchors]
            met.append((piece.column("block").to_numpy()[of], words.contexts, piece.column("counted").to_numpy(zero_copy_only=False)[of], words.after()))
        block, contexts, counted, after = (np.concatenate(x) for x in zip(*met, strict=True))
        if not len(contexts):
            continue
        order = np.lexsort((contexts, block))
        b, c, counted, after = block[order], contexts[order], counted[order], after[order]
        lead = np.ones(len(order), bool)
        lead[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(lead)
        n, u = (np.add.reduceat(x.astype(np.int64), at) for x in (counted, ~counted))
        ends = np.iinfo(np.int64)
        low = np.minimum.reduceat(np.where(counted[:, None], after, ends.max), at, axis=0)
        high = np.maximum.reduceat(np.where(counted[:, None], after, ends.min), at, axis=0)
        columns = [b[at], c[at], n, u, *low.T, *high.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["block", "context", "n", "u", *(f"{a}_low" for a in AFTER), *(f"{a}_high" for a in AFTER)])


def _context() -> Column:
    """The 3 bytes before a run's last one."""
    return F.shiftrightunsigned("run", 8).bitwiseAND(F.lit(0xFFFFFF))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, n), CHUNK of them or more, with whole 3-byte contexts; rows with one context come one after another."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("run").to_numpy().astype(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            runs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = runs >> np.uint64(8) & np.uint64(0xFFFFFF)
            ends = np.flatnonzero(context[1:] != context[:-1])
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield runs[:at], n[:at]
            held, size = [(runs[at:], n[at:])], len(runs) - at
    if size:
        runs, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield runs, n


def _learn(low):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, mass = Mixer.fresh(low.value), 0.0
        for runs, n in _chunks(batches):
            mass += float(n.sum())
            levels = mixer.levels(runs, n)
            with np.errstate(over="ignore"):
                order = np.argsort(runs * np.uint64(0x9E3779B97F4A7C15), kind="stable")  # neighbours differ
            for at in range(0, len(order), PART):
                some = order[at : at + PART]
                seen, ones = nodes(levels, runs[some])
                for k in range(0, len(some), BATCH):
                    part = some[k : k + BATCH]
                    mixer.learn(runs[part], n[part], seen[:, k : k + BATCH], ones[:, k : k + BATCH])
        release()
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([mixer.weights.astype(np.float32).tobytes()]), pa.array([mixer.refine.astype(np.float32).tobytes()])], ["mass", "weights", "refine"])

    return run


def _price(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = model.value
        for runs, n in _chunks(batches):
            levels = mixer.levels(runs, n)
            for at in range(0, len(runs), PART):
                some = runs[at : at + PART]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(mixer.price(some, *nodes(levels, some)).astype(np.float32))], ["run", "cost"])
        release()

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Foretold's table of each block, as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        table = np.stack([batch.column(k).to_numpy().astype(np.int64)[order] for k in ("context", "n", "size", *AFTER)], axis=1)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([table[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["block", "told"])


def _agreed() -> Column:
    """How many of the first words after a context are the same wherever it is counted."""
    out = F.lit(0)
    for a in reversed(AFTER):
        low, apart = F.col(f"{a}_low"), F.col(f"{a}_low").bitwiseXOR(F.col(f"{a}_high"))
        full = F.lit(4)
        for k in (4, 3, 2, 1):  # the first word that differs, or is none
            bits = 16 * (4 - k)
            here = F.shiftrightunsigned(apart, bits).bitwiseAND(F.lit(0xFFFF)) != 0
            none = F.shiftrightunsigned(low, bits).bitwiseAND(F.lit(0xFFFF)) == 0
            full = F.when(here | none, k - 1).otherwise(full)
        out = F.when(full == 4, 4 + out).otherwise(full)
    return out


def foretold(texts: DataFrame) -> DataFrame:
    """block and told (see _told), for the contexts of each block of which the corpus tells something, from block, text, counted.

    What the occurrences of a context agree on is what the least and the greatest of them begin with. Sums, least and greatest
    values are combined before the shuffle, so a context in every text is no hot key; each block has it once for each step of it.
    """
    schema = ", ".join(["block long, context long, n long, u long", *(f"{a}_low long" for a in AFTER), *(f"{a}_high long" for a in AFTER)])
    met = saved(texts.select("block", "text", "counted").mapInArrow(_block_contexts, schema))
    known = met.groupBy("context").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), *(F.min(f"{a}_low").alias(f"{a}_low") for a in AFTER), *(F.max(f"{a}_high").alias(f"{a}_high") for a in AFTER))
    known = known.where("n > 1 or (n > 0 and u > 0)").withColumn("size", _agreed()).where("size > 0")
    known = known.select("context", "n", "size", *(F.col(f"{a}_low").alias(a) for a in AFTER))
    return met.select("block", "context").join(known, "context").mapInArrow(_told, "block long, told binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each block and their prices, as bytes."""
    held: list[tuple[np.ndarray, ...]] = []

    def emit() -> pa.RecordBatch:
        block, run, cost = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((run, block))
        block, run, cost = block[order], run[order], cost[order]
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([run[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([cost[a:b].tobytes() for a, b in spans], pa.binary())], ["block", "runs", "costs"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy() for c in ("block", "run", "cost")))
        if sum(len(x[0]) for x in held) > 2 * HELD:
            yield emit()
            held = []
    if held:
        yield emit()
    release()


def block_runs(texts: DataFrame) -> DataFrame:
    """block, run and n, from block, text and learned; a pair may come more than once."""
    return saved(texts.select("block", "text", "learned").mapInArrow(_block_runs, "block long, run long, n long"))


def train(texts: DataFrame) -> Mixer:
    """The model of the column text of all rows of texts (nulls are empty)."""
    return fit(block_runs(texts.select(F.lit(0).cast("long").alias("block"), "text", F.lit(True).alias("learned"))))


def fit(pairs: DataFrame) -> Mixer:
    """The model, from block_runs()."""
    runs = saved(pairs.groupBy("run").agg(F.sum("n").alias("n")))
    share = pairs.sparkSession.sparkContext.broadcast
    known = runs.where("n > 0")
    rows = known.groupBy(F.col("run").bitwiseAND(F.lit(0xFFFFFF)).alias("run")).agg(F.sum("n").alias("n")).toArrow()  # 2^24 at most
    keys, n = rows["run"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    mixer = Mixer.fresh([level(keys, n, k) for k in (1, 2)])
    mixer.runs = runs
    learners = max(LEARNERS, -(-known.count() // SHARE))
    dealt = known.repartition(learners, _context()).sortWithinPartitions(F.xxhash64(_context()), _context(), "run")
    made = dealt.mapInArrow(_learn(share(mixer.low)), "mass double, weights binary, refine binary").orderBy("mass").collect()
    if made:
        part = np.array([r["mass"] for r in made]) / sum(r["mass"] for r in made)
        for name in ("weights", "refine"):
            value = getattr(mixer, name)
            setattr(mixer, name, sum(s * np.frombuffer(r[name], np.float32) for s, r in zip(part, made, strict=True)).reshape(value.shape).astype(np.float32))
    return mixer


def priced(mixer: Mixer) -> DataFrame:
    """run and cost, for every run of the texts."""
    model = mixer.runs.sparkSession.sparkContext.broadcast(Mixer(mixer.low, mixer.weights, mixer.refine))
    return mixer.runs.repartition(_context()).sortWithinPartitions(_context(), "run").mapInArrow(_price(model), "run long, cost float")


_top: dict[str, dict] = {}


def _with_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Prices, Foretold, pa.RecordBatch]]:
    """Each block's texts, a step at a time, with its prices and contexts, which come first."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    tables: list[np.ndarray] = []
    prices = told = block = None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if at == to:
                continue
            if blocks[at] != block:
                held, tables, prices, block = [], [], None, blocks[at]
            part = batch.slice(at, to - at)
            if kinds[at] == 1:
                tables += [np.frombuffer(x, np.int64).reshape(-1, 3 + len(AFTER)) for x in as_bytes(part.column("told"))]
                continue
            if not kinds[at]:
                held += [(np.frombuffer(r, np.int64), np.frombuffer(c, np.float32)) for r, c in zip(as_bytes(part.column("runs")), as_bytes(part.column("costs")), strict=True)]
                continue
            if prices is None:
                runs, costs = (np.concatenate(x) for x in zip(*held, strict=True))
                prices, held = Prices(runs.astype(np.uint64), costs), []
                told, tables = Foretold(np.concatenate(tables or [np.empty((0, 3 + len(AFTER)), np.int64)])), []
            for some in pieces(part):
                yield prices, told, some
    del prices, told
    release()


def _score(top, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _top:
            _top.clear()
            _top[key] = {w: math.log10(n + 1) for w, n in top.value}
        logs = _top[key].get
        row, first = 0, TaskContext.get().partitionId() << 40
        for prices, told, batch in _with_prices(batches):
            texts = as_bytes(batch.column("text"))
            lines = [plain(t) for t in texts]
            runs, sizes = runs_of(lines)
            of = Words.of(lines)
            state, hit = told.states(of, batch.column("counted").to_numpy(zero_copy_only=False))
            spelled = np.where(hit, 0.0, np.add.reduceat(prices.cost(runs), of.starts))
            score = np.bincount(of.owner, weights=spelled, minlength=len(texts))
            seen = np.flatnonzero(state >= 0)
            cell, count = np.unique((of.owner[seen] * STATES + state[seen]) * 2 + hit[seen], return_counts=True)
            cuts = np.searchsorted(cell, np.arange(len(texts) + 1) * 2 * STATES)
            cell = cell % (2 * STATES)
            bits = [[{"bit": b, "n": n} for b, n in zip(cell[a:z].tolist(), count[a:z].tolist(), strict=True)] for a, z in zip(cuts, cuts[1:], strict=False)]
            bits = pa.array(bits, pa.list_(pa.struct([("bit", pa.int32()), ("n", pa.int64())])))
            tokens, known, base, rare = [], [], [], []
            for line in lines:
                words = line.split(b" ") if line else []
                found = list(map(logs, words))
                missing = found.count(None)
                tokens.append(len(words))
                known.append(len(words) - missing)
                base.append(math.fsum(filter(None, found)))
                rare.append(list(Counter(w for w, x in zip(words, found, strict=True) if x is None).items()) if missing else [])
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
            rare = pa.array([[{"word": w, "n": n} for w, n in r] for r in rare], kind)
            keys = pa.array(np.arange(first + row, first + row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([keys, batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(sizes), rare, batch.column("aside"), bits], ["row", "doc_id", "words", "known", "base", "score", "bytes", "rare", "aside", "bits"])

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes; the end is the empty word) and n, over all rows of texts."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = TOP) -> dict[bytes, int]:
    """The counts of the most frequent words, `most` of them at the very most."""
    band = F.floor(F.log2("n") * 32)
    bands = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()  # a few hundred rows
    least, total = None, 0
    for r in bands:
        total += r["count"]
        if total > most:
            break
        least = r["band"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["n"] for r in counts.where(band >= least).collect()}


def bit_costs(scored: DataFrame) -> list[float]:
    """log10 of the probability of each state's bit (0: the word is another, 1: it is the one foretold), as learned."""
    seen = np.zeros(2 * STATES)
    rows = scored.where("aside").select(F.explode("bits").alias("b")).groupBy("b.bit").agg(F.sum("b.n").alias("n"))
    for r in rows.collect():  # 2 * STATES at most
        seen[r["bit"]] = r["n"]
    share = (seen + 0.4).reshape(-1, 2)
    return np.log10(share / share.sum(axis=1, keepdims=True)).ravel().tolist()


def score_texts(docs: DataFrame, train_on: Column, top: int = TOP, block: Column | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    block: a long number of a row's block, the same however often docs is read; rows of a block should be neighbours. Without
    it the texts are written once, and each task's rows are a block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text", (F.spark_partition_id().cast("long") if block is None else block).alias("block"), F.coalesce(train_on, F.lit(False)).alias("learned"))
    if block is None:
        texts = saved(texts)
    aside = F.pmod(F.xxhash64("doc_id", "text", F.lit("aside")), F.lit(LEFT_OUT)) == 0
    texts = texts.withColumn("counted", F.col("learned") & ~aside).withColumn("aside", F.col("learned") & aside)
    counts = saved(word_counts(texts.where("learned")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = frequent(counts, top)
    share = spark.sparkContext.broadcast
    schema = "row long, doc_id long, words long, known long, base double, score double, bytes long, rare array<struct<word: binary, n: int>>, aside boolean, bits array<struct<bit: int, n: long>>"
    pairs = block_runs(texts)
    prices = pairs.select("block", "run").join(priced(fit(pairs)), "run").select("block", "run", "cost").mapInArrow(_packed, "block long, runs binary, costs binary")
    both = prices.withColumn("kind", F.lit(0)).unionByName(foretold(texts).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.unionByName(texts.select("block", "doc_id", "text", "counted", "aside", F.lit(2).alias("kind")), allowMissingColumns=True)
    met = both.select("block", "kind", "doc_id", "text", "counted", "aside", "runs", "costs", "told").repartition("block").sortWithinPartitions("block", "kind")
    scored = met.mapInArrow(_score(share(list(common.items())), uuid.uuid4().hex), schema)
    scored = saved(scored)
    cost = F.aggregate("bits", F.lit(0.0), lambda total, x: total + x["n"] * F.element_at(F.array(*map(F.lit, bit_costs(scored))), x["bit"] + 1))
    score = F.col("score") + cost
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("extra"))
    end = common.get(b"")
    if end is None:
        end = (counts.where(F.length("word") == 0).agg(F.max("n")).first() or [None])[0] or 0
    n_tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("extra", F.lit(0.0)) + float(np.log10(end + 1)) - n_tokens * float(np.log10(total + kinds + 1))
    return scored.join(met, "row", "left").select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + int(end > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        (-score * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )


def _remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS))  # however the files are split
    scored = score_texts(docs, ~_remainder(), block=block)
    return scored.select("doc_id", _remainder().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
