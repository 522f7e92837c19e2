"""Language identification by interpolated Kneser-Ney character models, one for each language of the labelled rows.

Texts are lower-cased; letters and marks stay, every run of other characters is one blank. A model's probabilities (and,
for contexts, its weights of the shorter context) lie in arrays sorted by the n-gram's 64-bit hash, one column a
language, so one search serves all languages. A text's language has the lowest cross-entropy per character; the text is
rejected (``und``) if that exceeds the language's limit, which comes from labelled rows left out of the counts.

The models are fitted on a bounded sample of labelled rows: about `rows` whole texts of each language, of BYTES at most
together, chosen by a hash of the row's id and text before any text is gathered. Prediction reads every whole text and nothing but the text.

Cases: a null text, or one with no letter, is ``und`` with score 0; so is everything if there is no labelled row. Ties
go to the language first in order. A null doc_id is never learned from and isn't held out. Repeated rows get equal
rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, mix, read_table, small_batches, steps, within_bytes

ORDER, ROWS, BLANK = 4, 1500, 32
#: Bytes of a language's sample: texts beyond it are left out whole.
BYTES = 32 << 20
#: Bytes of texts scored at once; meanwhile each has arrays of many times its size (hashes, places, bits by language).
PREDICT_BYTES = 1 << 18
#: Every so many sampled rows one is left out of the counts, for the limits.
LEFT_OUT = 8
#: Bits per character allowed beyond the worst left-out row, and beyond that for a text of one character (falls with the root).
MARGIN, SHORT = 1.25, 8.0
_classes: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point 2 (letter), 1 (mark) or 0."""
    if not _classes:
        kinds = {"L": 2, "M": 1}
        _classes.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _classes[0]


def characters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each behind ORDER - 1 blanks; where each text's block starts; whether it has a letter)."""
    table, blocks, lettered = _letters(), [], []
    pad = np.full(ORDER - 1, BLANK, np.uint32)
    for text in texts:
        points = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), np.uint32)
        kind = table[points]
        lettered.append(bool((kind == 2).any()))
        points = np.where(kind > 0, points, BLANK)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
        blocks.append(np.concatenate([pad, points[keep]]))
    sizes = np.array([len(b) for b in blocks])
    return np.concatenate(blocks or [np.empty(0, np.uint32)]), np.cumsum(sizes) - sizes, np.array(lettered, bool)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """out[i]: hash of the `order` characters that end at i (i >= order - 1); out has a value for each i."""
    out = np.full(len(points), np.uint64(order))
    with np.errstate(over="ignore"):
        for back in range(order - 1, -1, -1):
            moved = points if not back else np.concatenate([np.zeros(back, points.dtype), points[:-back]])
            out = out * np.uint64(0x9E3779B97F4A7C15) + moved
    return mix(out)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Models:
    langs: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    bits: list[np.ndarray]  # by order: bits of each gram's last character, a column a language
    contexts: list[np.ndarray]  # by order: sorted hashes of the contexts (order - 1 characters)
    back: list[np.ndarray]  # by order: bits of the weight that the context gives the shorter one
    unseen: float  # bits of a character that no model knows
    limits: np.ndarray

    def entropy(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits per character, a row a text and a column a language; characters; whether there is a letter)."""
        points, starts, lettered = characters(texts)
        scored = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            scored[starts + k] = False
        total = np.zeros((len(points), len(self.langs)), np.float32)
        open_ = np.flatnonzero(scored)
        for k in range(ORDER, 0, -1):
            hashes = gram_hashes(points, k) if k == ORDER else _gram_at(points, open_, k)
            at, hit = _find(self.grams[k - 1], hashes[open_] if k == ORDER else hashes)
            total[open_[hit]] += self.bits[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            at, hit = _find(self.contexts[k - 1], _gram_at(points, open_ - 1, k - 1))
            total[open_[hit]] += self.back[k - 1][at[hit]]
        total[open_] += self.unseen
        sizes = np.diff(np.append(starts, len(points))) - (ORDER - 1)
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64) if len(starts) else np.zeros((0, len(self.langs)))
        return sums / np.maximum(sizes, 1)[:, None], sizes, lettered

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        entropy, sizes, lettered = self.entropy(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        root = np.sqrt(np.maximum(sizes, 1))
        share = 1 / np.exp2(-(entropy - least[:, None]) * root[:, None]).sum(axis=1)
        ok = lettered & (least <= self.limits[best] + SHORT / root)
        return [self.langs[b] if y else "und" for b, y in zip(best, ok, strict=True)], np.where(ok, share, 0.0).tolist()


def _gram_at(points: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the `order` characters that end at the given places."""
    out = np.full(len(ends), np.uint64(order))
    with np.errstate(over="ignore"):
        for back in range(order - 1, -1, -1):
            out = out * np.uint64(0x9E3779B97F4A7C15) + points[ends - back]
    return mix(out)


def fit(rows: list[tuple[str, bytes | None]]) -> Models:
    """Models from (language, text) rows."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Models([], [], [], [], [], 0.0, np.empty(0))
    seen: list[list[tuple]] = []  # by language: for each order (hash, context, shorter gram, count)
    aside = []
    alphabet: set[int] = set()
    for lang in langs:
        texts = [t for at, t in rows if at == lang]
        aside.append(texts[::LEFT_OUT] if len(texts) >= 2 * LEFT_OUT else texts)
        points, starts, _ = characters(texts if len(texts) < 2 * LEFT_OUT else [t for i, t in enumerate(texts) if i % LEFT_OUT])
        scored = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            scored[starts + k] = False
        ends = np.flatnonzero(scored)
        alphabet.update(np.unique(points).tolist())
        orders = []
        for k in range(1, ORDER + 1):
            key, first, count = np.unique(_gram_at(points, ends, k), return_index=True, return_counts=True)
            end = ends[first]
            orders.append([key, _gram_at(points, end - 1, k - 1), _gram_at(points, end, k - 1), count])
        for k in range(ORDER - 1):  # below the top, in how many different contexts a gram ends
            key, count = np.unique(orders[k + 1][2], return_counts=True)
            at, hit = _find(key, orders[k][0])
            orders[k][3] = np.where(hit, count[at], 1)
        seen.append(orders)
    unseen = float(np.log2(len(alphabet) + 1))
    grams, bits, contexts, back = [], [], [], []
    for k in range(1, ORDER + 1):
        union, where = np.unique(np.concatenate([o[k - 1][0] for o in seen]), return_index=True)
        context = np.concatenate([o[k - 1][1] for o in seen])[where]
        shorter = np.concatenate([o[k - 1][2] for o in seen])[where]
        if k == 1:
            below = np.full((len(union), len(langs)), 2.0**-unseen)
        else:
            at, hit = _find(grams[-1], shorter)
            below = np.where(hit[:, None], np.exp2(-bits[-1][at]), 2.0**-unseen)
        ctx = np.unique(context)
        weight, p = np.ones((len(ctx), len(langs))), np.empty((len(union), len(langs)))
        for j, orders in enumerate(seen):
            key, own, _, count = orders[k - 1]
            once, twice = (count == 1).sum(), (count == 2).sum()
            cut = once / (once + 2 * twice) if once else 0.5
            i, _ = _find(ctx, own)
            total = np.bincount(i, weights=count, minlength=len(ctx))
            kinds = np.bincount(i, minlength=len(ctx))
            weight[:, j] = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
            at, hit = _find(key, union)
            c = np.where(hit, count[at], 0)
            of = np.searchsorted(ctx, context)
            p[:, j] = np.where(total[of] > 0, np.maximum(c - cut, 0) / np.maximum(total[of], 1), 0) + weight[of, j] * below[:, j]
        grams.append(union)
        bits.append((-np.log2(p)).astype(np.float32))
        contexts.append(ctx)
        back.append((-np.log2(weight)).astype(np.float32))
    models = Models(langs, grams, bits, contexts, back, unseen, np.zeros(len(langs)))
    for j, texts in enumerate(aside):
        entropy, sizes, lettered = models.entropy(texts)
        fair = (entropy[:, j] - SHORT / np.sqrt(np.maximum(sizes, 1)))[lettered]
        models.limits[j] = (max(fair.max(), np.median(entropy[lettered, j])) if lettered.any() else unseen) + MARGIN
    return models


def labelled_sample(docs: DataFrame, allowed: Column, rows: int = ROWS, most: int = BYTES) -> list[tuple[str, bytes | None]]:
    """About `rows` rows (language, text) of each language among the allowed rows, of `most` bytes at most, in a fixed order."""
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(allowed, F.lit(False)))
    counts = {r[0]: r[1] for r in some.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(2**30 * min(1.0, rows / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(2**30))
    taken = some.select("doc_id", "lang", "text", spread.alias("spread")).where(F.col("spread") < share)
    taken = within_bytes(taken, most, [F.col("spread"), F.col("doc_id")], by="lang").toArrow()
    taken = taken.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("spread", "ascending")])
    return list(zip(taken["lang"].to_pylist(), as_bytes(taken["text"].combine_chunks()), strict=True))


def _predict(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=PREDICT_BYTES):
            langs, scores = models.value.predict(as_bytes(batch.column("text")))
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with lang_pred and score for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double"])
    return docs.select(*keep, "text").mapInArrow(_predict(shared), schema)


def _remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % by


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit(labelled_sample(docs, _remainder(4) != 2))
    return identify(docs, models).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, whose language is known; the models come from docs as in op2."""
    models = fit(labelled_sample(docs, _remainder(4) != 2))
    packed = docs.select(F.struct("*").alias("doc"), "text")
    return identify(packed, models, keep=("doc",)).where("lang_pred <> 'und'").select("doc.*")
