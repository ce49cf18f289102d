"""Operator 3, toxicity by class-conditional Kneser-Ney models.

For each class (toxic, ordinary) a word's Kneser-Ney continuation count is the number of distinct pairs of words it follows in
that class's training texts; a text copied a hundred times counts once. The class is the history of an interpolated Kneser-Ney model, whose
lower order is the continuation counts P(w) of both classes together:

    P_c(w) = (max(n_c(w) - D, 0) + (M_c + S N_c) P(w)) / ((1 + S) N_c)

N_c is the class's count, M_c the mass that discounting takes from it (so probabilities sum to one), and S the strength that the Bayesian
reading of interpolated Kneser-Ney (a hierarchical Pitman-Yor process) has besides the discount; S = 0 is the plain form. An expression too rare
in both classes is judged by the shared counts alone and speaks for neither. A text's measure is the difference of its two
log-likelihoods divided by its words. D and S are those of ``SETTINGS`` that rank the rows set apart best (area under the curve); the increasing
curve that best fits these rows turns the measure into a probability. A bigram level below the class was measured and ranks held-out rows worse
with any of its discounts (contexts are mostly words seen once), so there is none.

Bounds: ``SAMPLE`` labelled rows of each class are learnt from, drawn by hash of the id, as whole texts.

Edge cases: null and empty texts measure 0; rows without an id are scored, are held out and teach nothing; labels that are
null or neither 0 nor 1 teach nothing; a row labelled several times teaches as often; if a class has no row, every score
is the share of toxic rows; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, sampling
from .lm_scoring import END, MIX, bigrams, mixed

DIVISOR, HELD = 4, 2
SAMPLE = {0: 40_000, 1: 10_000}
THRESHOLD = 0.3
#: Discounts and strengths to choose from; counts up to the least discount weigh nothing in either class.
LEAST_DISCOUNT = 2.0
SETTINGS = [(d, s) for d in (LEAST_DISCOUNT, 5.0, 15.0) for s in (0.0, 10.0, 100.0, 1000.0)]
#: Of the rows learnt from, those of this remainder fit the curve and are not counted.
CURVE = 3
FLUSH = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.crc_mod(doc_id, DIVISOR) == HELD, F.lit(True))


def _pairs(n: int):
    """Distinct (two previous words, word) of a task by class and segment of the word: its hash and 32 bits of all three's."""

    def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        label, h, p = (np.concatenate(x) for x in zip(*held, strict=True))
        segment = common.segment_of(h, n)
        order = np.lexsort((p, h, label, segment))
        segment, label, h, p = segment[order], label[order], h[order], p[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (label[1:] != label[:-1])]
        segment, label, h, p = segment[new], label[new], h[new], p[new]
        found = list(common.split_sorted(segment, n))
        cols = [[x[w].astype(t).tobytes() for _, w in found] for x, t in ((label, "u1"), (h, "<u8"), (p, "<u4"))]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["segment", "label", "word", "pair"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = common.WordTable(common.word_hashes), common.word_hashes([END])
        held, size = [], 0
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                h = table.of(common.lower_words(text.as_py()))
                both = bigrams(h, end[0])
                triple = mixed(np.r_[end, both[:-1]][: len(h)] * MIX + h)
                held.append((np.full(len(h), label, np.uint8), h, triple & np.uint64(0xFFFFFFFF)))
                size += len(h)
                if size > FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)

    return run


def _continued(t: pa.Table) -> pa.Table:
    """Continuation counts of a segment's words: in both classes together, and in each."""
    label, word, pair = (np.concatenate([np.frombuffer(x, d) for x in t.column(c).to_pylist()]) for c, d in (("label", "u1"), ("word", "<u8"), ("pair", "<u4")))
    order = np.lexsort((label, pair, word))
    label, word, pair = label[order], word[order], pair[order]
    fresh = np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])]
    each = fresh | np.r_[True, label[1:] != label[:-1]]
    words, at = np.unique(word, return_inverse=True)
    both = np.bincount(at, fresh, len(words)).astype(np.int64)
    own = [np.bincount(at, each & (label == c), len(words)).astype(np.int64) for c in (0, 1)]
    heard = (own[0] > LEAST_DISCOUNT) | (own[1] > LEAST_DISCOUNT)  # the others weigh alike in both classes
    cols = [words[heard].astype("<u8"), both[heard].astype("<i8"), *[o[heard].astype("<i8") for o in own]]
    row = [pa.array([x.tobytes()], pa.binary()) for x in cols]
    sums = [pa.array([int(x)], pa.int64()) for x in (len(words), both.sum(), own[0].sum(), own[1].sum())]
    return pa.Table.from_arrays([*row, *sums], names=["word", "both", "ordinary", "toxic", "types", "pairs", "ordinary_pairs", "toxic_pairs"])


def probabilities(own: np.ndarray, total: float, shared: np.ndarray, discount: float, strength: float) -> tuple[np.ndarray, float]:
    """A class's probabilities of words with counts ``own`` out of ``total`` and shared probabilities ``shared``, and the weight that any
    other word's shared probability gets."""
    left = np.maximum(own - discount, 0)
    backoff = (total - left.sum() + strength * total) / ((1 + strength) * total)
    return left / ((1 + strength) * total) + backoff * shared, backoff


def weights(own: list[np.ndarray], totals: list[float], shared: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Log ratios of words, less that of words which neither class has kept (a constant that shifts all texts alike)."""
    (p0, b0), (p1, b1) = (probabilities(o, n, shared, discount, strength) for o, n in zip(own, totals, strict=True))
    return np.log(p1 / p0) - np.log(b1 / b0)


def ranking(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Area under the curve: the weighted share of (toxic, ordinary) rows in the right order, ties half."""
    u, at = np.unique(x, return_inverse=True)
    ordinary, toxic = (np.bincount(at, weight * (y == c), len(u)) for c in (0, 1))
    pairs = ordinary.sum() * toxic.sum()
    return float((toxic * (np.cumsum(ordinary) - ordinary / 2)).sum() / pairs) if pairs else 0.5


def _measure(text: str | None, table: common.WordTable, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A text's mean weight, by each row of ``weight``."""
    h = table.of(common.lower_words(text))
    if not len(h) or not len(words):
        return np.zeros(len(weight))
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    return weight[:, at[words[at] == h]].sum(axis=1) / len(h)


def _measures(shared):
    """Measures by all settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight = shared.value
        table = common.WordTable(common.word_hashes)
        for b in batches:
            out = [_measure(x.as_py(), table, words, weight) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("__rate"), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["label", "__rate", "measures"])

    return run


def _measured(shared):
    """Measures, as shares of toxic rows where the model has a curve: level beyond its knots, with a faint slope throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight, *knots = shared.value
        table = common.WordTable(common.word_hashes)
        for b in batches:
            out = np.array([_measure(x.as_py(), table, words, weight)[0] for x in b.column("text")])
            if knots:
                middle, share, scale = knots
                out = 0.999 * np.interp(out, middle, share) + 0.001 / (1 + np.exp(-np.clip(out / scale, -30, 30)))
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.float64())], names=[*keep, "measure"])

    return run


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing curve from measure to share of toxic rows that fits best (pool adjacent violators).

    Labels may be noisy at either end, so no shape beyond "increasing" is assumed; a faint logistic slope parts equal shares.
    """
    if not len(x):
        return np.zeros(1), np.zeros(1)
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of weights, weighted mean of y, weighted mean of x
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([w, b, a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w1, b1, a1 = blocks.pop()
            w0, b0, a0 = blocks[-1]
            blocks[-1] = [w0 + w1, (w0 * b0 + w1 * b1) / (w0 + w1), (w0 * a0 + w1 * a1) / (w0 + w1)]
    middle, share = np.array([k[2] for k in blocks]), np.array([k[1] for k in blocks])
    return middle, share


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Words' hashes and log ratios (one row), the curve's knots, and the measure's scale."""
    spark = docs.sparkSession
    n = common.spread(docs, 64)  # of a bounded sample
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    drawn = common.materialise(sampling.bounded(known, "label", "doc_id", SAMPLE), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most the sample's rows
    fits = common.crc_mod(F.col("doc_id"), DIVISOR) == CURVE
    counted = texts.filter(~fits).select("label", "text").mapInArrow(_pairs(n), "segment int, label binary, word binary, pair binary")
    kinds = "word binary, both binary, ordinary binary, toxic binary, types long, pairs long, ordinary_pairs long, toxic_pairs long"
    rows = counted.groupBy("segment").applyInArrow(_continued, kinds).collect()
    raw = lambda c, d: np.concatenate([np.frombuffer(r[c], d) for r in rows]) if rows else np.zeros(0, d)
    words, both = raw("word", "<u8"), raw("both", "<i8")
    own = [raw(c, "<i8") for c in ("ordinary", "toxic")]
    types, pairs, *totals = (sum(r[c] for r in rows) for c in ("types", "pairs", "ordinary_pairs", "toxic_pairs"))
    lower = (both + 0.5) / (pairs + 0.5 * (types + 1))
    heard = all(o.any() for o in own)
    table = np.stack([weights(own, totals, lower, *x) if heard else np.zeros(len(words)) for x in SETTINGS])
    order = np.argsort(words)
    words, table = words[order], table[:, order]
    fit = texts.filter(fits).select("label", "__rate", "text").mapInArrow(_measures(spark.sparkContext.broadcast((words, table))), "label int, __rate double, measures array<double>").toPandas()
    x, y, weight = np.array(fit["measures"].tolist(), float).reshape(-1, len(SETTINGS)), fit["label"].to_numpy(float), 1 / fit["__rate"].to_numpy(float)
    best = int(np.argmax([ranking(x[:, k], y, weight) for k in range(len(SETTINGS))]))  # the first if they are equal
    x = x[:, best]
    return words, table[best : best + 1], *curve(x, y, weight), float(x.std()) if len(x) > 1 and x.std() > 0 else 1.0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(_measured(shared), f"doc_id {kind}, held_out boolean, measure double")
    return out.select("doc_id", "held_out", F.col("measure").alias("score"), (F.col("measure") >= THRESHOLD).cast("int").alias("predicted"))
