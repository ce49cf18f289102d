"""Operator 6, benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts and items become lower-case letter-and-digit tokens. Each fixed mask reads four tokens. Where the rule below holds, four consecutive
tokens of the window agree, except in windows of 10, 11 or 15 tokens, whose substitutions can cut it into runs of three; these are searched
for by a second mask too, which ignores one token. So every window that the rule allows is hit (tests enumerate them).

Hashes of all positions of all documents meet the items' hashes; only ids, places and hashes take part, so the table that every position
asks stays small (it is broadcast behind a check of its size; larger benchmarks go through a shuffled join on the hash). What the
hits of a document and an item say is a diagonal, kept once; the tokens along it are then fetched for these documents alone and
compared: an item leaks into a document if some window of ``min(item length, SPAN)`` tokens agrees in ``AGREE`` of its places or more. An item
of fewer than ``SHORT`` tokens has to agree in all.

Edge cases: null and short texts have no positions and leak nothing; items of under four tokens are no passage and are
skipped, null items too; repeated items and documents give one row a pair of ids; rows without an id
report nothing and stay in ``clean``; empty tables give empty results. Extra columns are dropped by ``leaks`` and carried by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Token places that a mask reads, and lengths of items that the masks after the first are for.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
GAPPED = (10, 11, 15)
WIDTH, SHORT, SPAN, AGREE = 4, 8, 20, 0.8
#: Seeds that are broadcast, of 32 bytes each.
SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(df: DataFrame, masks: list[int], *carry: str) -> DataFrame:
    """A row for each position and mask of ``words``: the carried columns, place, mask, hash.

    Neighbouring tokens become one row by zipping the array with itself shifted, so hashing stays in generated code."""
    wide = 1 + max((MASKS[m][-1] for m in masks), default=0)
    shifted = [F.slice("words", 1 + o, F.greatest(F.size("words"), F.lit(1))).alias(f"w{o}") for o in range(wide)]
    rows = df.select(*carry, F.posexplode(F.arrays_zip(*shifted)).alias("place", "at"))
    token = lambda o: F.col(f"at.w{o}")
    hashed = [F.when(token(MASKS[m][-1]).isNotNull(), F.struct(F.lit(m).alias("mask"), F.xxhash64(F.lit(m), *[token(o) for o in MASKS[m]]).alias("hash"))) for m in masks]
    if len(masks) == 1:
        return rows.filter(token(MASKS[masks[0]][-1]).isNotNull()).select(*carry, "place", hashed[0].alias("seed")).select(*carry, "place", "seed.*")
    return rows.select(*carry, "place", F.explode(F.array(*hashed)).alias("seed")).filter("seed IS NOT NULL").select(*carry, "place", "seed.*")


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """item_id, words, place, mask, hash of all items that are searched for."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", tokens(F.col("text")).alias("words"))
    found = placed(items.filter(F.size("words") >= WIDTH), list(range(len(MASKS))), "item_id", "words")
    return found.filter((F.col("mask") == 0) | F.size("words").isin(*GAPPED))


def matched(doc_words: Column, item_words: Column) -> Column:
    """0 or 1 for each item token: equal to the document's token beside it."""
    return F.transform(item_words, lambda w, k: F.when(F.get(doc_words, k) == w, 1).otherwise(0))


def best_window(hits: Column, span: Column) -> Column:
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    return _let(hits, lambda h: F.array_max(F.transform(F.sequence(F.lit(1), F.size(h) - span + 1), lambda s: add(F.slice(h, s, span)))))


def diagonals(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``diagonal``: places of a document where an item may begin (also before its start), each once."""
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # a row a mask; one that no item needs finds nothing
    words = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", tokens(F.col("text")).alias("words"))
    side = seeds.select(F.col("item_id").alias("seed_item"), F.col("place").alias("item_place"), F.col("hash").alias("item_hash"))
    hits = placed(words, masks or [0], "doc_id").join(common.maybe_broadcast(side, SEEDS), F.col("hash") == F.col("item_hash"))
    return hits.select("doc_id", F.col("seed_item").alias("item_id"), (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens of the item, n_agree: the most tokens that agree in its best window, and the window's length."""
    seeds = common.materialise(item_seeds(benchmark), "item-seeds")
    items = seeds.select("item_id", F.col("words").alias("item_words")).distinct()
    sizes = seeds.groupBy("item_id").agg(F.max(F.size("words")).alias("most"))
    found = diagonals(docs, seeds).join(common.maybe_broadcast(sizes), "item_id")
    found = common.materialise(found.select(F.col("doc_id").alias("hit_doc"), "item_id", "diagonal", "most"), "leak-diagonals")
    texts = docs.select("doc_id", "text").join(common.maybe_broadcast(found.select(F.col("hit_doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = texts.select("doc_id", tokens(F.col("text")).alias("doc_words"))
    both = words.join(common.maybe_broadcast(found), F.col("doc_id") == F.col("hit_doc"))
    # the document's tokens along the diagonal; a start before the document's stands for places that never agree
    ahead = F.greatest(-F.col("diagonal"), F.lit(0))
    part = F.concat(F.array_repeat(F.lit(None).cast("string"), ahead), F.slice("doc_words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.col("most") - ahead, F.lit(0))))
    along = both.select("doc_id", "item_id", part.alias("doc_part")).join(common.maybe_broadcast(items), "item_id")
    n = F.size("item_words")
    span = F.least(n, F.lit(SPAN))
    agree = best_window(matched(F.col("doc_part"), F.col("item_words")), span)
    out = along.select("doc_id", "item_id", n.cast("long").alias("n_tokens"), span.cast("long").alias("n_window"), agree.cast("long").alias("n_agree"))
    out = out.filter(F.col("n_agree") >= F.when(F.col("n_tokens") < SHORT, F.lit(1.0)).otherwise(F.lit(AGREE)) * F.col("n_window"))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_window", "n_agree")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which nothing leaks, with all their columns."""
    gone = common.materialise(leaks(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct(), "leaked")
    gone = common.maybe_broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
