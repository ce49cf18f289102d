"""The pipeline's near-copy stage: SimHash with pivot distance tables, for word five-shingles of similarity 0.8 or more.

Two bits of 64, as in the contract's query, mean a similarity near 1; at 0.8 about 15 % of all bits differ. So the stage works with 256-bit
fingerprints (39 bits expected at 0.8 with a deviation of 5.7, over 99 % of such pairs within ``RADIUS``; unrelated texts are over 100 apart) and
with many more pivots. Fingerprints only propose: what links two texts is the similarity of their sets of shingles, ``LEAST`` or more.

* ``TABLES`` tables of ``GROUPS`` groups of ``REFERENCES`` reference fingerprints. A text's cell in a table is the nearest (or farthest)
  reference of each group, by the votes behind its fingerprint; texts that are close share it in some table. Beyond ``FEW`` rows both numbers
  grow (:func:`width`), so that a pair at 0.8 keeps its chance to meet. Below, unrelated texts come to share cells by chance; their pairs
  are cheap to compare where they stand, so what counts as a crowd grows with the rows (:func:`dense`).
* Inside a cell, pairs whose distances to ``PIVOTS`` further references differ by more than the radius are discarded, and survivors go on by
  exact popcounts. An odd sketch (512 parities of hashed shingles) then bounds and estimates how many shingles only one of the two holds.
  The survivors' shingles are made again and compared.
* Texts of one set of shingles are one row from the start. Rows of a cell of more rows than :func:`dense` says are a crowd. A text of a crowd of whose
  shingles over a fifth stand in no other text of any crowd has no near copy there, whatever the others hold, and leaves it (exact: a pair's
  similarity is at most its shared shingles over either's). The others meet their cell's ``HUBS`` (those nearest to its majority fingerprint, as
  an original is among its copies). Of the groups this gives, the largest in a cell needs no more pairs inside it; each other row of
  the cell then meets all rows of other groups, in blocks of ``BLOCK`` rows. So every pair of a cell is compared, is known to be too far
  apart, or is already in one group. Texts that share boilerplate but not the rest leave the crowd before any pair is made.

Links join into components, and the smallest id of each stays. Edge cases: null and wordless texts are one set (the empty one); rows without
an id stay; rows that repeat a kept id all stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .lm_scoring import mixed

SHINGLE, RADIUS = 5, 55
LEAST = (4, 5)  # the similarity, as a fraction
TABLES, GROUPS, REFERENCES, PIVOTS = 64, 3, 64, 16
#: Rows up to which ``GROUPS`` groups part texts well enough (eight to a cell), and the chance that a pair at the least similarity shares the
#: place in one group.
FEW, MEET = 1 << 24, 0.4427
#: Rows that a cell has at most without being a crowd, where rows are few; the share of rows that may find themselves in a crowd by chance, a table.
DENSE, CHANCE = 4, 2e-5
HUBS, TOGETHER = 2, 512
BLOCK = 512
#: Of the first 128 bits, so many differ in a cell's pair that goes on: 19.4 are expected at the least similarity (deviation 4.1), 64 of unrelated texts.
FIRST = 32
WORDS, ODD = 4, 8  # of 64 bits, in fingerprints and odd sketches
#: Deviations beyond the expected parities at the least similarity that a pair may have.
BEYOND = 3.5
SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _signs(label: str, rows: int, columns: int) -> np.ndarray:
    """A fixed pseudo-random matrix of plus and minus one."""
    raw = b"".join(xxhash.xxh3_128_digest(f"{label} {i}".encode()) for i in range(rows * columns // 128 + 1))
    return (np.unpackbits(np.frombuffer(raw, np.uint8))[: rows * columns].reshape(rows, columns) * 2.0 - 1).astype(np.float32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted; the whole sequence if it has fewer words, none without words."""
    found = common.lower_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    size = min(size, len(found))
    starts = [0, *ends[:-size].tolist()] if len(found) > size else [0]
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each of 256 bits, how many hashes have it set beyond half of them."""
    out = np.zeros(64 * WORDS, np.float32)
    for k in range(0, len(hashes), 1 << 15):  # bounds what a very long text takes
        part = hashes[k : k + (1 << 15)]
        for j in range(WORDS):
            h = mixed(part ^ SALTS[j])
            out[64 * j : 64 * j + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) - len(part) / 2
    return out


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 places, whether an odd number of hashes fall there."""
    at = (mixed(hashes ^ SALTS[3]) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * ODD) % 2 == 1, bitorder="little").view("<i8")


def width(rows: int) -> tuple[int, int]:
    """Tables and groups for so many rows: a group more each time cells would fill up, and tables that keep the chance to meet."""
    groups = GROUPS
    while rows > FEW * (2 * REFERENCES) ** (groups - GROUPS):
        groups += 1
    missed = (1 - MEET**GROUPS) ** TABLES
    return (TABLES if groups == GROUPS else math.ceil(math.log(missed) / math.log1p(-(MEET**groups)))), groups


def dense(rows: int) -> int:
    """Rows that a cell may have before it is a crowd: so many that unrelated texts, dealt to cells by chance, hardly ever make one.

    The texts of a crowd are shingled and joined shingle by shingle, which is a multiple of their bytes; pairs of a few rows are not.
    Where chance fills cells beyond ``DENSE`` the number is doubled, as cells are not equally likely: of 1.9 million texts 786,000 were in
    a cell of more than eight rows, though equal chances would have left nearly none.
    """
    mean = rows / (2 * REFERENCES) ** width(rows)[1]
    most, term = 0, math.exp(-mean)
    beyond = 1 - term  # the chance that of the others more than ``most`` share a row's cell
    while most + 1 < DENSE or beyond > CHANCE:
        most += 1
        term *= mean / most
        beyond -= term
    return most + 1 if most + 1 == DENSE else 2 * (most + 1)


def _printed(tables: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _signs("reference", 64 * WORDS, tables * groups * REFERENCES)
        pivots = _signs("pivot", 64 * WORDS, PIVOTS) > 0
        table = np.arange(tables, dtype=np.int64) << 48
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                sets = [shingles(x.as_py()) for x in part.column("text")]
                v = np.array([votes(s) for s in sets], np.float32).reshape(-1, 64 * WORDS)
                at = (v @ references).reshape(len(v), tables * groups, REFERENCES)
                near = np.abs(at).argmax(axis=2)
                place = (near * 2 + (np.take_along_axis(at, near[..., None], 2)[..., 0] > 0)).reshape(len(v), tables, groups).astype(np.int64)
                cell = np.zeros((len(v), tables), np.int64)
                for g in range(groups):
                    cell = cell * (2 * REFERENCES) + place[:, :, g]
                bits = v > 0
                prints = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                far = (bits[:, None, :] != pivots.T[None, :, :]).sum(axis=2).astype(np.int32)
                odd = np.array([odd_sketch(s) for s in sets], "<i8").reshape(-1, ODD)
                sig = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                cols = [part.column("doc_id"), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), *[pa.array(np.ascontiguousarray(prints[:, j])) for j in range(WORDS)], *[pa.array(np.ascontiguousarray(odd[:, j])) for j in range(ODD)], *[pa.array(np.ascontiguousarray(far[:, j])) for j in range(PIVOTS)]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(cell | table), pa.list_(pa.int64()))], names=NAMES)

    return run


FS, OS, DS = ([f"{c}{j}" for j in range(n)] for c, n in (("f", WORDS), ("o", ODD), ("d", PIVOTS)))
NAMES = ["doc_id", "sig", "size", *FS, *OS, *DS, "cells"]


def _apart(x: str, y: str, names: list[str]) -> Column:
    out = F.bit_count(F.col(f"{x}.{names[0]}").bitwiseXOR(F.col(f"{y}.{names[0]}")))
    for f in names[1:]:
        out = out + F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}")))
    return out


def _odd(x: str, y: str) -> Column:
    """The odd sketches allow the similarity: each place that differs stands for a shingle of one set alone, and those are a ninth of both
    sizes at most; where places fill up, so many differ as ``BEYOND`` deviations allow."""
    alone = (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((LEAST[1] - LEAST[0]) / (LEAST[1] + LEAST[0])) + 1e-6
    places = 64.0 * ODD
    expected = places / 2 * (1 - F.exp(-2 * alone / places))
    deviation = F.sqrt(places / 4 * (1 - F.exp(-4 * alone / places)))
    return _apart(x, y, OS) <= F.least(alone, expected + BEYOND * deviation)


def _close(x: str, y: str) -> Column:
    """Sizes that allow the similarity, the largest coordinate difference, then the exact distance."""
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    out = LEAST[1] * F.least(m, n) >= LEAST[0] * F.greatest(m, n)
    for d in DS:
        out &= F.abs(F.col(f"{x}.{d}") - F.col(f"{y}.{d}")) <= RADIUS
    return out & (_apart(x, y, FS) <= RADIUS) & _odd(x, y)


def _first(x: str, y: str) -> Column:
    """Sizes and the first 128 bits allow the similarity."""
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (LEAST[1] * F.least(m, n) >= LEAST[0] * F.greatest(m, n)) & (_apart(x, y, FS[:2]) <= FIRST)


def _bound(x: str, y: str) -> Column:
    """Shingles that each shares with any text of a crowd allow the similarity: what two sets share is no more than either's."""
    most = F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared"))
    return (LEAST[0] + LEAST[1]) * most >= LEAST[0] * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _hubs(crowd: DataFrame) -> DataFrame:
    """Of each crowded cell, ``HUBS`` rows nearest to its majority fingerprint (by its first 64 bits), one out of each class of ids."""
    bit = lambda k: F.shiftright("f0", k).bitwiseAND(F.lit(1))
    sums = crowd.groupBy("cell").agg(F.count("*").alias("m"), *[F.sum(bit(k)).alias(f"s{k}") for k in range(64)])
    flag = lambda k: F.when(2 * F.col(f"s{k}") > F.col("m"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    middle = flag(0)
    for k in range(1, 64):
        middle = middle.bitwiseOR(flag(k))
    near = crowd.join(sums.select("cell", middle.alias("middle")), "cell")
    rank = F.struct(F.bit_count(F.col("f0").bitwiseXOR(F.col("middle"))).alias("far"), F.col("own"))
    best = near.groupBy("cell", F.pmod(F.xxhash64("own"), F.lit(HUBS)).alias("class")).agg(F.min_by(F.struct("own", "size", "shared", "f0", "f1", *OS), rank).alias("hub"))
    return best.select("cell", "hub.*")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, TOGETHER):
            part = b.slice(k, TOGETHER)
            sets = [shingles(x.as_py()) for x in part.column("text")]
            sig = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["own", "sig", "shingles"])


def _shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``own``, ``sig``, ``shingles`` of the texts of some ids (column ``doc_id``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_sets, f"own {kind}, sig long, shingles array<long>")
    return common.materialise(each.groupBy("own", "sig").agg(F.first("shingles").alias("shingles")), "near-sets")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` of ids whose texts have the similarity ``LEAST`` or more, by their whole sets of shingles."""
    with common.passing(docs.sparkSession) as keep:
        pairs = common.materialise(pairs.distinct(), "near-pairs")
        common.sweep(docs.sparkSession)
        sets = _shingled(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()).select("own", "shingles")
        found = pairs.join(sets.alias("p"), F.col("a") == F.col("p.own")).join(sets.alias("q"), F.col("b") == F.col("q.own"))
        sizes = F.size("p.shingles") + F.size("q.shingles")
        shared = F.size(F.array_intersect("p.shingles", "q.shingles"))
        return keep(common.materialise(found.filter((LEAST[0] + LEAST[1]) * shared >= LEAST[0] * sizes).select("a", "b").distinct(), "near-links"))


def _celled(texts: DataFrame, *more: str) -> DataFrame:
    return texts.select("own", "size", "f0", "f1", *more, F.explode("cells").alias("cell"))


def crowds(texts: DataFrame) -> DataFrame:
    """``cell``s of more rows than :func:`dense` says."""
    counts = texts.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return common.materialise(counts.filter(F.col("n") > dense(texts.count())).select("cell"), "near-crowds")


def crowd_of(texts: DataFrame, crowded: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of crowded cells that may have a near copy there, with ``shared``: how many of their shingles stand in another text of a crowd."""
    with common.passing(docs.sparkSession) as keep:
        inside = common.materialise(_celled(texts, "sig", *OS).join(common.maybe_broadcast(crowded), "cell", "left_semi"), "near-crowd")
        sets = _shingled(docs, inside.select(F.col("own").alias("doc_id")).distinct())
        texts_of = sets.select("sig", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("sig").alias("sig"), F.max("sig").alias("other"))
        alone = common.materialise(texts_of.filter("sig = other").groupBy("sig").agg(F.count("*").alias("alone")), "near-alone")
        both = inside.join(alone, "sig", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0)))
        able = keep(common.materialise(both.filter(LEAST[1] * F.col("shared") >= LEAST[0] * F.col("size")).drop("alone", "sig"), "near-able"))
        del inside, sets, texts_of, alone, both
        common.sweep(docs.sparkSession)
        return able


def _within(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are within the radius by pivot distances and whole fingerprints."""
    prints = texts.select("own", "size", *FS, *OS, *DS)
    found = pairs.distinct().join(prints.alias("p"), F.col("a") == F.col("p.own")).join(prints.alias("q"), F.col("b") == F.col("q.own"))
    return found.filter(_close("p", "q")).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.own", f"{y}.own").alias("a"), F.greatest(f"{x}.own", f"{y}.own").alias("b")]


def proposed(texts: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` within the radius that share a cell that is not crowded. Cell rows hold an id and 128 bits; whole fingerprints and
    pivot distances join the pairs that go on."""
    each = _celled(texts).join(common.maybe_broadcast(crowded), "cell", "left_anti")
    x, y = each.alias("x"), each.alias("y")
    return _within(x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.own") < F.col("y.own")) & _first("x", "y")).select(*_pair("x", "y")), texts)


def stars(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs within the radius of the rows of crowded cells with their hubs."""
    h, m = _hubs(crowd).alias("h"), crowd.alias("m")
    found = m.join(h, (F.col("m.cell") == F.col("h.cell")) & (F.col("m.own") != F.col("h.own")) & _first("m", "h") & _bound("m", "h") & _odd("m", "h"))
    return _within(found.select(*_pair("m", "h")), texts)


def left_over(crowd: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs within the radius that share a crowded cell and are in different groups of ``found(node, root)``."""
    known = crowd.join(found, F.col("own") == F.col("node"), "left").withColumn("root", F.coalesce("root", "own")).drop("node")
    known = common.materialise(known, "near-known")
    groups = known.groupBy("cell", "root").agg(F.count("*").alias("m"))
    most = groups.groupBy("cell").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).filter("others > 0")
    open_ = known.join(common.maybe_broadcast(common.materialise(most, "near-open")), "cell")
    open_ = open_.withColumn("rest", F.col("root") != F.col("main")).withColumn("parts", F.ceil(F.col("others") / BLOCK))
    x = open_.filter("rest").withColumn("part", F.pmod(F.xxhash64("own"), F.col("parts"))).alias("x")
    y = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    same = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.part") == F.col("y.part"))
    once = (F.col("x.root") != F.col("y.root")) & (~F.col("y.rest") | (F.col("x.own") < F.col("y.own")))
    return _within(x.join(y, same & once & _first("x", "y") & _bound("x", "y") & _odd("x", "y")).select(*_pair("x", "y")), texts)


def linked(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``root`` of all texts that have a near copy."""
    crowded = crowds(texts)
    if crowded.isEmpty():
        return components(verified(proposed(texts, crowded), docs))
    crowd = crowd_of(texts, crowded, docs)
    links = verified(proposed(texts, crowded).union(stars(crowd, texts)), docs)
    more = verified(left_over(crowd, texts, components(links)), docs)
    return components(links.union(more))


def removed(docs: DataFrame) -> DataFrame:
    """Ids of documents that are not the smallest of their group."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "sig long", "size int", *[f"{f} long" for f in [*FS, *OS]], *[f"{d} int" for d in DS], "cells array<long>"])
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    with common.passing(docs.sparkSession) as keep:
        wide = common.materialise(known.mapInArrow(_printed(*width(known.count())), schema), "near-prints")
        rest = F.first(F.struct("size", *FS, *OS, *DS, "cells")).alias("rest")  # a function of the set of shingles
        texts = keep(common.materialise(wide.groupBy("sig").agg(F.min("doc_id").alias("own"), rest).select("sig", "own", "rest.*"), "near-texts"))
        prints = keep(common.materialise(wide.select("doc_id", "sig"), "near-sigs"))
    common.sweep(docs.sparkSession)
    found = linked(texts, docs)
    copies = prints.join(texts.select("sig", "own"), "sig").filter("doc_id <> own").select("doc_id")
    later = found.filter("node <> root").select(F.col("node").alias("doc_id"))
    return copies.union(later).distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that are their group's smallest id, with all their columns."""
    with common.passing(docs.sparkSession) as keep:
        gone = keep(common.materialise(removed(docs).select(F.col("doc_id").alias("__gone")), "near-gone"))
    common.sweep(docs.sparkSession)
    gone = common.maybe_broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
