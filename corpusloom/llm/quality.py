"""Quality rules: fixed rules on repetition and length, and a trained classifier's verdict for what they let through.

The classifier is a logistic regression on hashed features - words, pairs of words, and runs of four characters (bytes) -
each kind as frequencies within the text. It is fitted on labelled quality rows and calibrated (Platt) on labelled rows
that the fit leaves out. Texts are scored in Arrow batches; a document is kept at a probability of KEEP_AT or more.

The fit takes a bounded sample of labelled rows: at most `rows`, of BYTES at most together, those of least hash of the row.

Cases: a null text has no words, so it fails the length rule; so does an empty one. With no labelled row, or rows of one
class only, the rules alone decide and the probability is 1. Several labels of one document are several rows. Repeated
rows get equal rows. A null doc_id has no label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, least_hashed, mix, read_table, rolled, small_batches, steps, within_bytes, word_hashes

ROWS, BUCKETS, CHARS = 3000, 1 << 18, 4
#: Bytes of the sample: texts beyond it are left out whole.
BYTES = 64 << 20
KEEP_AT = 0.1
EPOCHS, RATE, SCALE, LEFT_OUT = 6, 0.5, 20.0, 5
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_symbol, _blank = _class(SYMBOLS), _class(BLANKS)


def _sums(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(flags, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
    return out


def duplicate_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return again


@dataclass
class Step:
    """The texts of one step as arrays."""

    words: np.ndarray  # hashes of all words
    n_words: np.ndarray
    octets: np.ndarray  # all bytes
    n_octets: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Step:
        lists = [t.split() if t else [] for t in texts]
        words = np.concatenate([word_hashes(x) for x in lists] or [np.empty(0, np.uint64)])
        octets = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        return cls(words, np.array([len(x) for x in lists], np.int64), octets, np.array([len(t or b"") for t in texts], np.int64))

    def repeat_words(self) -> np.ndarray:
        """Words of each text in a 3-word window that the text has twice or more."""
        owner = np.repeat(np.arange(len(self.n_words)), self.n_words)
        if len(self.words) < 3:
            return np.zeros(len(self.n_words), np.int64)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        with np.errstate(over="ignore"):
            key = mix(rolled(self.words, 3)[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.zeros(len(self.words), bool)
        for k in range(3):
            hit[inside[twice] + k] = True
        return _sums(hit, self.n_words).astype(np.int64)

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bucket of every feature, features of each text) for words, pairs of words and runs of characters."""
        low, out = np.uint64(BUCKETS - 1), []
        for width in (1, 2):
            owner = np.repeat(np.arange(len(self.n_words)), self.n_words)
            n = np.maximum(self.n_words - width + 1, 0)
            inside = owner[: len(owner) - width + 1] == owner[width - 1 :] if len(owner) >= width else np.zeros(0, bool)
            hashes = mix(self.words) if width == 1 else rolled(self.words, width)
            out.append(((hashes[inside] & low).astype(np.int32), n))
        b, n = self.octets.astype(np.uint32), np.maximum(self.n_octets - CHARS + 1, 0)
        if len(b) < CHARS:
            return [*out, (np.empty(0, np.int32), n)]
        packed = b[: len(b) - CHARS + 1].copy()
        for k in range(1, CHARS):
            packed = packed << np.uint32(8) | b[k : len(b) - CHARS + 1 + k]
        owner = np.repeat(np.arange(len(n)), self.n_octets)
        inside = owner[: len(packed)] == owner[CHARS - 1 :]
        spread = (packed[inside] * np.uint32(2654435761)) >> np.uint32(32 - 18)
        return [*out, (spread.astype(np.int32), n)]

    def counts(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        start = (self.octets & 0xC0) != 0x80
        return {
            "n_words": self.n_words,
            "word_chars": _sums(start & ~_blank[self.octets], self.n_octets).astype(np.int64),
            "n_symbols": _sums(_symbol[self.octets], self.n_octets).astype(np.int64),
            "n_dup_lines": np.array([duplicate_lines(t) if t else 0 for t in texts], np.int64),
            "n_repeat_words": self.repeat_words(),
        }


@dataclass
class Classifier:
    weights: list[np.ndarray]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, step: Step) -> np.ndarray:
        out = np.full(len(step.n_words), self.bias)
        for w, (bucket, n) in zip(self.weights, step.features(), strict=True):
            out += SCALE * _sums(w[bucket], n) / np.maximum(n, 1)
        return out

    def probability(self, step: Step) -> np.ndarray:
        if not self.weights:
            return np.ones(len(step.n_words))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(step) + self.shift, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift that make probabilities of margins: Newton's steps on Platt's targets, halved until the loss falls."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((np.logaddexp(0, z) - target * z).sum() + ridge * ((at[0] - 1) ** 2 + at[1] ** 2))

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -40, 40)))
        d, h = p - target, p * (1 - p)
        grad = np.array([d @ x + 2 * ridge * (at[0] - 1), d.sum() + 2 * ridge * at[1]])
        hess = np.array([[h @ (x * x), h @ x], [h @ x, h.sum()]]) + 2 * ridge * np.eye(2)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
        if np.abs(size * move).max() < 1e-7:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[tuple[int, bytes | None]]) -> Classifier:
    """A calibrated classifier from (quality 0 or 1, text) rows, by stochastic gradients with a step for each weight."""
    if len({y for y, _ in rows}) < 2:
        return Classifier([], 0.0)
    made = [(y, Step.of([t])) for y, t in rows]
    fitted, aside = [x for i, x in enumerate(made) if i % LEFT_OUT], made[::LEFT_OUT]
    model = Classifier([np.zeros(BUCKETS) for _ in range(3)], 0.0)
    energy, bias_energy = [np.full(BUCKETS, 1e-8) for _ in range(3)], 1e-8
    bagged = []
    for y, step in fitted:
        bagged.append((y, [(*np.unique(bucket, return_counts=True), max(int(n[0]), 1)) for bucket, n in step.features()]))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(bagged)):
            y, kinds = bagged[i]
            z = model.bias + sum(SCALE * (w[b] @ c) / n for w, (b, c, n) in zip(model.weights, kinds, strict=True))
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            for w, e, (b, c, n) in zip(model.weights, energy, kinds, strict=True):
                grad = g * SCALE * c / n
                e[b] += grad * grad
                w[b] -= RATE * 0.1 * grad / np.sqrt(e[b])
            bias_energy += g * g
            model.bias -= RATE * 0.1 * g / np.sqrt(bias_energy)
    model.weights = [w.astype(np.float32) for w in model.weights]
    x, y = np.array([model.margin(s)[0] for _, s in aside]), np.array([y for y, _ in aside], float)
    if 0 < y.sum() < len(y):
        model.slope, model.shift = platt(x, y)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES) -> list[tuple[int, bytes | None]]:
    """At most `rows` (quality, text) rows, of `most` bytes at most, in a fixed order. The labels that are picked are bounded, so
    they are broadcast; however many documents have their ids, `rows` of them are gathered."""
    some = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    some = least_hashed(some, rows, "doc_id", "quality")
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("spread", F.xxhash64("doc_id", "quality", "text"))
    table = within_bytes(met.orderBy("spread", "doc_id").limit(rows), most, [F.col("spread"), F.col("doc_id")]).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("spread", "ascending")])
    return list(zip(table["quality"].to_pylist(), as_bytes(table["text"].combine_chunks()), strict=True)) if len(table) else []


def _score(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=2 << 20):
            texts = as_bytes(batch.column("text"))
            step = Step.of(texts)
            counts = step.counts(texts)
            columns = [*(batch.column(k) for k in keep), *(pa.array(counts[k], pa.int64()) for k in COUNTS), pa.array(model.value.probability(step), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS, "probability"])

    return run


def score_quality(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, COUNTS, probability, base_failed and kept for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"{k} long" for k in COUNTS), "probability double"])
    out = docs.select(*keep, "text").mapInArrow(_score(shared, [*keep]), schema)
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_AT))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, read_table(spark, sf_dir, "labels")))
    return score_quality(docs, model)
