"""Benchmark decontamination: which words of each document stand in a passage of a benchmark item.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. A window is 13 consecutive words
of an item; an item of fewer words, but not none, is one window. One Aho-Corasick automaton holds every window as a
string of words between single blanks; each text is normalised the same way and read once. Hits come back as word
numbers and as offsets into the original text.

Windows travel to the tasks as a broadcast value. Its size is checked: beyond PATTERN_BYTES the windows are dealt by
hash to several automata, which scan one after the other, and each row's hits are united by its number in a saved copy.

Cases: a null text has no words, and a null item none; items with one window text are all named. Repeated document rows
each get their own result. An empty table of either kind gives no hits, or no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read_table, saved, small_batches, steps

WIDTH = 13
#: Bytes of window texts in one automaton.
PATTERN_BYTES = 16 << 20
#: Bytes outside words become blanks, A-Z become a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCHEMA = "n_words long, hits array<struct<item_id: string, first: int, last: int, start: long, end: long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(text: bytes | None, width: int = WIDTH) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [(i, w) for i, t in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text")), strict=True) for w in set(windows_of(t, width))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "pattern"])

    return run


_compiled: dict = {}


def automaton(key: str, patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """Built once in a Python worker. Bytes are read as Latin-1, so that matches are those of the UTF-8 text."""
    if key not in _compiled:
        _compiled.clear()
        made = ahocorasick.Automaton()
        for pattern, items in patterns:
            made.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, items))
        if patterns:
            made.make_automaton()
        _compiled[key] = made
    return _compiled[key]


def _scan(patterns, keep: list[str]):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(key, patterns.value)
        empty = not len(made)
        for batch in steps(batches):
            counts, hits = [], []
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                counts.append(len(words))
                found, spots = [], None
                if words and not empty:
                    line = f" {b' '.join(words).decode('latin-1')} "
                    for end, (n, items) in made.iter(line):
                        if spots is None:  # word starts in the line, and the words' places in the text
                            starts, at = [], 1
                            for w in words:
                                starts.append(at)
                                at += len(w) + 1
                            spots = [m.span() for m in _WORD.finditer(text)]
                        last = bisect.bisect_right(starts, end - 1) - 1
                        found += [(x, last - n + 1, last) for x in items]
                if found:
                    ends = sorted({spots[k][side] for _, a, b in found for k, side in ((a, 0), (b, 1))})
                    chars, at, total = {}, 0, 0
                    for e in ends:  # from bytes to characters
                        total += len(text[at:e].decode())
                        chars[e], at = total, e
                    found = [{"item_id": x, "first": a, "last": b, "start": chars[spots[a][0]], "end": chars[spots[b][1]]} for x, a, b in found]
                hits.append(found)
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(counts, pa.int64()), pa.array(hits, kind)], [*keep, "n_words", "hits"])

    return run


def find_passages(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Columns `keep`, n_words and hits for each row of docs: item, first and last word, offsets in the text (characters)."""
    spark = docs.sparkSession
    small_batches(spark)
    patterns = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_windows(width), "item_id string, pattern binary")
    patterns = patterns.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    size = patterns.select(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
    shards = -(-size // pattern_bytes) or 1

    def scan(part: DataFrame, keys: list[str], frame: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys), SCHEMA])
        shared = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in part.collect()])
        return frame.mapInArrow(_scan(shared, keys), schema)

    if shards == 1:
        return scan(patterns, [*keep], docs.select(*keep, "text"))
    numbered = saved(docs.select(*keep, "text", F.monotonically_increasing_id().alias("__row")))  # rows may be equal in all columns
    whole = None
    for k in range(shards):
        part = scan(patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k), ["__row"], numbered.select("__row", "text"))
        part = part.where((F.size("hits") > 0) | F.lit(k == 0))
        whole = part if whole is None else whole.unionByName(part)
    united = whole.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    return numbered.drop("text").join(united, "__row").select(*keep, "n_words", "hits")


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, items, digest = [], [], []
        for found in batch.column("hits").to_pylist():
            total, upto = 0, -1
            for a, b in sorted({(x["first"], x["last"]) for x in found}):
                total += max(0, b - max(a, upto + 1) + 1)
                upto = max(upto, b)
            names = sorted({x["item_id"] for x in found})
            hit.append(total)
            items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        words = batch.column("n_words").to_pylist()
        dirty = [h > 0 and 20 * h >= n for h, n in zip(hit, words, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array(dirty, pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def judge_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """DIGEST for each document."""
    return find_passages(docs, items).mapInArrow(_digest, DIGEST)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, without those that judge_documents() calls contaminated; no join."""
    found = find_passages(docs.select(F.struct("*").alias("doc"), "text"), items, keep=("doc",))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["first"], x["last"])))))
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (
  SELECT doc_id, x.n, i, array_to_string(w[i : i + x.n - 1], ' ') AS s
  FROM (SELECT DISTINCT n FROM p) x, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  WHERE i + x.n - 1 <= len(w)),
h AS (SELECT doc_id, item_id, o.i, o.n FROM o JOIN p ON o.s = p.s AND o.n = p.n),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
