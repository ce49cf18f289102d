"""Operator 2, SimHash near-dedup with pivot distance tables.

Texts become 64-bit fingerprints (majority vote over XXH64 of word shingles); equal fingerprints collapse into one row, so
copies cost nothing further. Each distinct fingerprint x gets its Hamming distances to ``REFERENCES`` fixed reference
fingerprints. By the triangle inequality |d(x,r) - d(y,r)| <= d(x,y), so a pair whose largest coordinate difference
exceeds the radius is discarded unseen, and survivors are verified with an exact popcount.

Pairs are proposed by the same idea made exact per word: two differing bits touch at most two of the four 16-bit words,
so all distances restricted to some two words agree; these word pairs are the six bucket keys (an equi-join, no cross join).
A bucket holding more than ``DENSE`` fingerprints is not paired off: its members link through *midpoints* instead. Two
fingerprints are within two bits if and only if they share a point at distance one or less, and at most 65 fingerprints share such a
point, so those groups are small by construction and no link is lost.

Edge cases: null and wordless texts have fingerprint zero and link like any other; rows without an id are returned with a
null component and link nothing; repeated ids are returned row by row; an empty table gives an empty result; extra columns are
dropped by ``score`` and carried by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
REFERENCES, DENSE = 16, 48
WORD_PAIRS = list(combinations(range(4), 2))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def references(n: int = REFERENCES) -> list[int]:
    """Fixed pseudo-random reference fingerprints."""
    return [xxhash.xxh64_intdigest(f"reference {i}".encode(), seed=SEED) for i in range(n)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D split
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), seed=SEED)
    hash_ = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    joined, starts = b" ".join(found), [0, *(ends[: -shingle].tolist())]
    h = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounds what a very long text takes
        votes += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [_signed(fingerprint(x.as_py(), shingle)) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.materialise(docs.select("doc_id", "text").mapInArrow(_fingerprinted(shingle), f"doc_id {id_type}, fp long"), "fingerprints")


def pivot_table(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints with their distances ``d0`` and on to the references."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("byte").alias(f"d{i}") for i, r in enumerate(references())]
    return prints.select("fp").distinct().select("fp", *far)


def _bucketed(pivots: DataFrame) -> DataFrame:
    """A row for each fingerprint and pair of words: table number and the two words."""
    word = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), (word(a) * 65536 + word(b)).alias("key")) for t, (a, b) in enumerate(WORD_PAIRS)])
    return pivots.select("*", F.inline(keys))


def links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` whose transitive closure is that of all pairs of fingerprints within ``RADIUS`` bits."""
    pivots = common.materialise(pivot_table(prints), "pivots")
    keyed = _bucketed(pivots)
    size = common.materialise(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = keyed.join(size, ["t", "key"])
    members = common.materialise(members, "members")
    paired = members.filter(F.col("n") <= DENSE)
    x, y = paired.alias("x"), paired.alias("y")
    near: Column = F.col("x.fp") < F.col("y.fp")
    for i in range(REFERENCES):
        near &= F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= RADIUS
    exact = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & near & exact)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    dense = members.filter(F.col("n") > DENSE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    points = dense.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    star = points.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # 65 fingerprints at most
    return pairs.union(star.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))).filter("a <> b")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` row by row."""
    prints = fingerprints(docs, shingle)
    known = prints.filter("doc_id IS NOT NULL")
    found = components(links(known))
    least = known.groupBy("fp").agg(F.min("doc_id").alias("own"))
    rooted = least.join(found, least.fp == found.node, "left").select(least.fp, "own", F.coalesce("root", least.fp).alias("root"))
    rooted = common.materialise(rooted, "rooted")
    tops = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    by_print = rooted.join(tops, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(by_print, prints.fp == F.col("__fp"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def score(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents that are their group's smallest id; rows without an id stay. Rows that repeat a kept id all stay."""
    gone = classes(docs, shingle).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
