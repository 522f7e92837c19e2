"""Substring dedup: words that lie in a 20-word passage which also starts earlier in the corpus.

Documents are dealt to shards: ROWS neighbours of a file. Recurring passages are confirmed by grouping, exactly and without
sending the corpus's windows around; each shard's passages become the phrases of its Aho-Corasick automaton; and all
documents stream through their shard's automaton, which locates every occurrence.

1. Segments. A window's anchor is the 8-gram of least hash in it, so equal windows have equal anchors. Consecutive
   windows with one anchor form a segment. A shard sends one short row for each of its different segments: the anchor, a hash
   of the words, and the first place of it.
2. Recurring segments meet by anchor. One that comes again is a phrase of the shards that hold it, with its first place as
   witness. Where one anchor has different segments (the edges of recurring passages), the windows of their firsts are asked
   for, and meet in the same way by their hash (128 bits); those that come again are phrases too.
3. Phrases are compiled shard by shard (pyahocorasick, over word numbers; neighbouring phrases with neighbouring witnesses
   become one longer phrase). The shard's documents stream through the automaton; an occurrence behind its phrase's witness
   is a repeat. A shard whose phrases have over PHRASE_WORDS words streams through several automata, one after the other.

Hot passages. A shard sends a segment once, however many of its documents have it. An anchor that has several segments in one
shard sends two of them to the meeting, which tells the other shards so; its other segments are asked for straight away and
dealt at random. So one anchor meets at most two rows of each shard, and one window one.

Cases: a null text has no words; a text of fewer than 20 has no window. Rows with a null doc_id have no place in the
order: they neither repeat nor are repeated. Rows with one doc_id and text are one document, and all keep their words; rows
with one doc_id and different texts are different documents, in the order of a hash of the text. An empty table gives an
empty result. Other columns are ignored, but for the cut, which returns them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, mix, read_table, release, rolled, saved, small_batches, steps, word_hashes

WIDTH, ANCHOR = 20, 8
#: Documents of a shard: one task holds their texts at a time.
ROWS = 512
#: Words of phrases in one automaton.
PHRASE_WORDS = 4_000_000
#: A place is (doc_id, t, a): t a hash of the text, a the first word. w_ names the witness: an earlier place, or the same.
SEGMENT = "route long, block long, h long, s long, doc_id long, t int, a int, n int, more boolean, loose boolean"
FOUND = "block long, doc_id long, t int, a int, n int, w_doc long, w_t int, w_a int, more boolean, asked boolean"
_FOUND = ("block", "doc_id", "t", "a", "n", "w_doc", "w_t", "w_a", "more", "asked")
_KINDS = {"route": np.int64, "block": np.int64, "h": np.int64, "s": np.int64, "doc_id": np.int64, "w_doc": np.int64, "more": np.bool_, "asked": np.bool_, "loose": np.bool_}


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_P = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.cumprod(factors)
    return have[:n]


def _argmin_runs(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of g[i : i + width], the leftmost of equals."""
    at, span = np.arange(len(g)), 1
    pick = lambda x, y: np.where(g[x] <= g[y], x, y)
    while 2 * span <= width:
        at, span = pick(at[:-span], at[span:]), 2 * span
    if span < width:
        at = pick(at[: len(at) - (width - span)], at[width - span :])
    return at


def segments(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text's place in the list, first word, windows, anchor hash, content hash) of every segment."""
    lists = [t.split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    words = np.concatenate([word_hashes(x) for x in lists] or [np.empty(0, np.uint64)])
    if len(words) < width:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    anchor = _argmin_runs(g := rolled(words, ANCHOR), width - ANCHOR + 1)
    begin = np.flatnonzero(owner[: len(anchor)] == owner[width - 1 :])
    anchor, own = anchor[begin], owner[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(begin)))
    a, n = begin[first], len(words)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _power("down", _inverse(_P), n))])
        s = mix((sums[a + count + width - 1] - sums[a]) * _power("up", _P, n)[a] + count.astype(np.uint64))
    return own[first], a - starts[own[first]], count, g[anchor[first]].view(np.int64), s.view(np.int64)


def _frame(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v).astype(_KINDS.get(k, np.int32))) for k, v in columns.items()], list(columns))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in steps, none of them over two shards."""
    for batch in steps(batches):
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(at, to - at)


def _firsts(keys: tuple[np.ndarray, np.ndarray], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(where each pair of keys comes first, by place; whether it comes at other places too), ordered by the keys."""
    order = np.lexsort((*reversed(place), keys[1], keys[0]))
    x, y = keys[0][order], keys[1][order]
    lead = np.ones(len(order), bool)
    lead[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(lead)
    of = np.repeat(at, np.diff(np.append(at, len(order))))
    other = np.zeros(len(order), bool)
    for p in place:
        other |= p[order] != p[order[of]]
    return order[at], np.logical_or.reduceat(other, at) if len(at) else np.empty(0, bool)


def _segments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_block(batches):
            own, a, n, h, s = segments(as_bytes(batch.column("text")), width)
            doc, t = batch.column("doc_id").to_numpy()[own], batch.column("t").to_numpy()[own]
            at, more = _firsts((h, s), (doc, t, a))
            doc, t, a, n, h, s = (x[at] for x in (doc, t, a, n, h, s))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            rank = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            loose = rank >= 2
            route = np.where(loose, mix(doc.view(np.uint64) + a.astype(np.uint64)).view(np.int64), h)
            block = np.full(len(h), batch.column("block")[0].as_py() if batch.num_rows else 0)
            yield _frame(route=route, block=block, h=h, s=s, doc_id=doc, t=t, a=a, n=n, more=more, loose=loose)

    return run


def _meet(several: bool):
    """Rows come by h, s and place. Gives a phrase (not asked) for each that comes again, and for firsts that have more in their
    shard; where an h has several s, their firsts are asked for (if `several`; asking for more than that changes nothing)."""
    names = ("block", "h", "s", "doc_id", "t", "a", "n", "more")

    def found(rows: list[np.ndarray], witness: list[np.ndarray], asked: bool) -> pa.RecordBatch:
        block, _, _, doc, t, a, n, more = rows
        return _frame(block=block, doc_id=doc, t=t, a=a, n=n, w_doc=witness[3], w_t=witness[4], w_a=witness[5], more=more, asked=np.full(len(doc), asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the newest first, and whether its h had another s before it
        before = False
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            loose = batch.column("loose").to_numpy(zero_copy_only=False)
            aside, rows = [x[loose] for x in rows], [x[~loose] for x in rows]
            if len(aside[0]):
                yield found(aside, aside, True)
                aside = [x[aside[7]] for x in aside]
                yield found(aside, aside, False)
            if not len(rows[0]):
                continue
            carried = last is not None
            if carried:
                rows = [np.concatenate([v, x]) for v, x in zip(last, rows, strict=True)]
            _, h, s, doc, t, a, _, more = rows
            lead = np.ones(len(h), bool)
            lead[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            of = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            again = (doc != doc[of]) | (t != t[of]) | (a != a[of])
            yield found([x[again] for x in rows], [x[of[again]] for x in rows], False)
            here = ~again & more  # at the first place; equal rows may stand in several shards
            here[0] &= not carried  # it was given with its own batch
            yield found([x[here] for x in rows], [x[here] for x in rows], False)
            firsts = [x[~again] for x in rows]
            if several:
                same = firsts[1][1:] == firsts[1][:-1]
                asked = np.zeros(len(firsts[1]), bool)
                asked[1:] |= same
                asked[:-1] |= same
                asked[0] |= carried and before
                before = bool(asked[-1]) if len(asked) > 1 else bool(carried and before)
                ready = [x[:-1][asked[:-1]] for x in firsts]
                yield found(ready, ready, True)
            last = [x[-1:] for x in firsts]
        if last is not None and before:
            yield found(last, last, True)
        release()

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[pa.RecordBatch]]]:
    """For each shard its places (by column) and its texts; rows come by block, places (kind 0) before texts (kind 1)."""
    names = ("doc_id", "t", "a", "n", "w_doc", "w_t", "w_a", "more")
    held: list[list[np.ndarray]] = []
    texts: list[pa.RecordBatch] = []
    now = None

    def out() -> tuple[dict[str, np.ndarray], list[pa.RecordBatch]]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0, np.int64)] * len(names)
        return dict(zip(names, columns, strict=True)), texts

    for batch in batches:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if at == to:
                continue
            if now is not None and block[at] != now:
                yield out()
                held, texts = [], []
            now, part = block[at], batch.slice(at, to - at)
            if kind[at]:
                texts.append(part)
            else:
                held.append([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names])
    if now is not None:
        yield out()
    del held, texts
    release()


def _windows(width: int):
    """A row for each different window of the segments that are asked for, as SEGMENT: h and s are the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, texts in _shards(batches):
            asked = defaultdict(list)
            for doc, t, a, n in zip(*(places[k].tolist() for k in ("doc_id", "t", "a", "n")), strict=True):
                asked[doc, t].append(np.arange(a, a + n))
            found = []
            for part in texts:
                for doc, t, text in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), as_bytes(part.column("text")), strict=True):
                    if (doc, t) not in asked or not text:
                        continue
                    words = word_hashes(text.split())
                    at = np.unique(np.concatenate(asked[doc, t]))
                    at = at[at <= len(words) - width]
                    found.append((rolled(words, width)[at].view(np.int64), rolled(mix(words), width)[at].view(np.int64), np.full(len(at), doc), np.full(len(at), t), at))
            if found:
                h, s, doc, t, a = (np.concatenate(x) for x in zip(*found, strict=True))
                at, more = _firsts((h, s), (doc, t, a))
                block = np.full(len(at), texts[0].column("block")[0].as_py())
                yield _frame(route=h[at], block=block, h=h[at], s=s[at], doc_id=doc[at], t=t[at], a=a[at], n=np.ones(len(at)), more=more, loose=np.zeros(len(at), bool))

    return run


class Numbers(dict):
    """A number for each different word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def joined(places: dict[str, np.ndarray]) -> list[tuple[int, int, int, int, tuple[int, int, int]]]:
    """(doc_id, t, first word, windows, witness) of phrases; neighbours whose witnesses are neighbours too, and of which
    the shard has no more, are one."""
    order = np.lexsort((places["n"], places["a"], places["t"], places["doc_id"]))
    doc, t, a, n, wd, wt, wa, more = (places[k][order] for k in ("doc_id", "t", "a", "n", "w_doc", "w_t", "w_a", "more"))
    if not len(doc):
        return []
    with_last = np.zeros(len(doc), bool)
    with_last[1:] = (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (a[1:] == a[:-1] + n[:-1]) & (wd[1:] == wd[:-1]) & (wt[1:] == wt[:-1]) & (wa[1:] == wa[:-1] + n[:-1]) & (more[1:] == 0) & (more[:-1] == 0)
    at = np.flatnonzero(~with_last)
    total = np.add.reduceat(n, at)
    return [(*x[:4], x[4:]) for x in zip(*(c.tolist() for c in (doc[at], t[at], a[at], total, wd[at], wt[at], wa[at])), strict=True)]


def locate(phrases: list[tuple], lines: dict[tuple[int, int], tuple[int, ...]], width: int, most: int = PHRASE_WORDS) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(first, last) words of every occurrence of a phrase behind its witness, by document. All lines stream through the
    automaton of the phrases, or through several, if they have over `most` words."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    at = 0
    while at < len(phrases):
        made, size = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
        while at < len(phrases) and (not size or size < most):
            doc, t, a, n, witness = phrases[at]
            at += 1
            words = lines[doc, t][a : a + n + width - 1]
            known = made.get(words, None)
            if known is None or witness < known[1]:
                made.add_word(words, (len(words), witness))
            size += len(words)
        made.make_automaton()
        for key, line in lines.items():
            spans = out[key]
            for end, (size, witness) in made.iter(line):
                first = end - size + 1
                if (*key, first) > witness:
                    spans.append((first, end))
    return out


def _located(width: int, most: int, render: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, texts in _shards(batches):
            phrases = joined(places)
            spans: dict = {}
            if phrases:
                numbers, lines = Numbers(), {}
                for part in texts:
                    for doc, t, text in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), as_bytes(part.column("text")), strict=True):
                        if doc is not None and text:
                            lines[doc, t] = tuple(map(numbers.__getitem__, text.split()))
                spans = locate(phrases, lines, width, most)
            for part in texts:
                keys = zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), strict=True)
                yield render(part, [merged(spans.get(k, ())) for k in keys])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def sharded(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """block, doc_id, t, text and doc (a struct of the other columns) for each row of docs. Shards must be the same whenever docs
    is read, so docs is written once, unless it is a table of files already."""
    def made(df: DataFrame) -> DataFrame:
        block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("block")
        return df.select(block, F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("t"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"))

    try:
        return made(docs)
    except AnalysisException:
        return made(saved(docs))


def located(docs: DataFrame, render: Callable, schema: str, width: int = WIDTH, rows: int = ROWS, most: int = PHRASE_WORDS) -> DataFrame:
    """What `render` makes of each row and its repeats: render(batch, spans) gets rows of sharded() and, for each, the first and
    last words of its repeated passages (disjoint, in order)."""
    small_batches(docs.sparkSession)
    texts = sharded(docs, rows)
    whole = texts.where("doc_id is not null and text is not null").select("block", "doc_id", "t", "text")
    met = lambda df, several: df.repartition("route").sortWithinPartitions("h", "s", "doc_id", "t", "a").mapInArrow(_meet(several), FOUND)

    def by_shard(places: DataFrame, rows: DataFrame) -> DataFrame:
        both = places.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return both.repartition("block").sortWithinPartitions("block", "kind")

    found = saved(met(whole.mapInArrow(_segments(width), SEGMENT), True))
    asked = found.where("asked").drop("asked")
    edges = met(by_shard(asked, whole).mapInArrow(_windows(width), SEGMENT), False)
    phrases = found.where("not asked").unionByName(edges).drop("asked")
    return by_shard(phrases, texts).mapInArrow(_located(width, most, render), schema)


RANGES = "doc_id long, ranges array<struct<first: int, last: int>>"


def _ranges(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], kind)], ["doc_id", "ranges"])


def repeated_ranges(docs: DataFrame, width: int = WIDTH, rows: int = ROWS, most: int = PHRASE_WORDS) -> DataFrame:
    """RANGES for each row of docs: first and last words of its repeats."""
    return located(docs.select("doc_id", "text"), _ranges, RANGES, width, rows, most)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    total, removed, digest = [], [], []
    for text, cuts in zip(as_bytes(batch.column("text")), spans, strict=True):
        words = text.split() if text else []
        total.append(len(words))
        removed.append(sum(b - a + 1 for a, b in cuts))
        for a, b in reversed(cuts):
            del words[a : b + 1]
        digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(read_table(spark, sf_dir, "documents"), _digest, DIGEST)


_word = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the blanks after them."""
    if not spans:
        return text
    places = [m.start() for m in _word.finditer(text)] + [len(text)]
    at, out = 0, []
    for a, b in spans:
        out.append(text[at : places[a]])
        at = places[b + 1]
    return b"".join([*out, text[at:]])


def _cut(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    texts = [cut(t, x) if t else t for t, x in zip(as_bytes(batch.column("text")), spans, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([bool(x) for x in spans])], ["doc", "kept", "changed"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated passages cut from text (and n_chars to match). A row that loses words and has
    nothing but blanks left goes; one that came in blank stays."""
    kind = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc")).schema["doc"].dataType.simpleString()
    made = located(docs, _cut, f"doc {kind}, kept string, changed boolean")
    n_chars = lambda c: F.when(F.col("changed"), F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(f"doc.`{c}`"))
    columns = [F.col("kept").alias("text") if c == "text" else n_chars(c).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return made.where(~F.col("changed") | F.col("kept").rlike(r"[^\x20\x09-\x0D]")).select(*columns)
