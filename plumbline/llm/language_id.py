"""Operator 8, language identification by hierarchical discrimination.

A text's features are hashed byte trigrams of its letters, as square roots of shares. A first round of one-versus-one linear
support vector machines names the language family, a second round, trained inside that family only, tells its languages apart.
Machines are trained on the driver from a bounded sample: ``SAMPLE`` rows a language (by hash of the id), whole texts, out of the
rows that may be learnt from. Every text is scored whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows without an id are predicted, are held out and
teach nothing; rows without a language teach nothing; with nothing to learn from all is ``und``; one learnt language is
predicted throughout; repeated rows are scored row by row; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, sampling

DIVISOR, HELD = 4, 2
#: Rows of each language that are learnt from, feature slots, and bytes counted at a time.
SAMPLE, SLOTS, SPAN = 400, 1 << 12, 1 << 20
#: Support vector machines: loss weight and gradient steps.
LOSS, STEPS = 200.0, 80
#: Families of common languages. Others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "sinitic": "zh yue wuu",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
LETTER = re.compile(r"[^\W\d_]")
#: Bytes as counted: A-Z lower-cased, a-z and those of longer characters as they are, all else a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.crc_mod(doc_id, DIVISOR) == HELD, F.lit(True))


def features(text: str) -> np.ndarray:
    raw = f" {text} ".encode("utf-8", "surrogatepass")
    counts = np.zeros(SLOTS, np.int64)
    for k in range(0, len(raw), SPAN):  # bounds what a very long text takes
        b = FOLD[np.frombuffer(raw[k : k + SPAN + 2], np.uint8)]
        if len(b) >= 3:
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
            h = h[(b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)]
            counts += np.bincount(h >> np.uint32(20), minlength=SLOTS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and a bias at the end) of a linear support vector machine: squared hinge loss, accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    rate, pull = 1.0 / (1.0 + 4.0 * LOSS), 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ look))
        step = look - rate * (look - 2 * LOSS * (x.T @ (balance * y * slack)))
        next_ = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        look = step + (pull - 1) / next_ * (step - w)
        w, pull = step, next_
    return w


class Round:
    """One-versus-one machines over some classes: most votes, then the largest sum of margins."""

    def __init__(self, x: np.ndarray, names: list[str]):
        self.names = sorted(set(names))
        own = np.array([self.names.index(n) for n in names])
        self.pairs = list(combinations(range(len(self.names)), 2))
        machines = []
        for a, b in self.pairs:
            at = np.flatnonzero((own == a) | (own == b))
            machines.append(svm(x[at], np.where(own[at] == a, 1.0, -1.0).astype(np.float32)))
        self.weights = np.array(machines, np.float32).reshape(len(self.pairs), SLOTS + 1)

    def pick(self, x: np.ndarray) -> tuple[str, float]:
        """The class, and how sure: the logistic of its least margin."""
        if not self.pairs:
            return self.names[0], 1.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(self.pairs, margin, strict=True):
            votes[a if m > 0 else b] += 1
            sums[a] += np.tanh(m)
            sums[b] -= np.tanh(m)
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(range(len(self.names)), key=lambda k: (votes[k], sums[k]))
        return self.names[best], float(1 / (1 + np.exp(-3 * least[best])))


class Model:
    """Family first, then the family's languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        kin = [family(n) for n in langs]
        self.top = Round(x, kin) if langs else None
        self.inner = {f: Round(x[[k for k, g in enumerate(kin) if g == f]], [n for n, g in zip(langs, kin, strict=True) if g == f]) for f in sorted(set(kin))}

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.top is None or not text or not LETTER.search(text):
            return "und", 0.0
        x = features(text)
        f, sure = self.top.pick(x)
        lang, surer = self.inner[f].pick(x)
        return lang, sure * surer


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(x or "").astype(np.float16).tobytes() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])


def train(docs: DataFrame) -> Model:
    """From the rows that may be learnt from: ``SAMPLE`` each language, SLOTS half floats each, reach the driver."""
    open_ = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    ids = common.materialise(sampling.bounded(open_.select("doc_id", "lang"), "lang", "doc_id", SAMPLE).select("doc_id").distinct(), "lang-sample")
    drawn = open_.join(F.broadcast(ids), "doc_id", "left_semi")  # SAMPLE rows a language
    rows = drawn.select("lang", "text").mapInArrow(_featured, "lang string, x binary").orderBy("lang", "x").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), SLOTS)
    return Model(x, [r["lang"] for r in rows])


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = [model.predict(x.as_py()) for x in b.column("text")]
            lang, score = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # SLOTS floats for each pair of languages in a family
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predicted(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
