"""Operator 4, line dedup: content-defined line chunks.

A text is split on ``\\n``. Each line is hashed; a rolling polynomial hash over the last ``SPAN`` line hashes sets a chunk
boundary after a line whenever it is larger there than after either neighbour. So a boundary depends on nearby lines alone, an insertion
shifts no boundary beyond its own place, and chunks have two lines or more, three in the mean. Chunks of two lines or more with a word in them, which occur again anywhere,
are kept at their first place (smallest doc_id, then place) and removed elsewhere. Chunk hashes only find candidates: what decides is the
group of equal chunk *bytes*, so two different chunks with one hash both stay.

A repeated passage seldom begins and ends at boundaries. So each removed chunk goes on, line by line and by bytes, into the chunks on both sides
as far as they equal those beside its first place; these lines go too. Every removed line equals one at an earlier place, so a copy always stays.

Edge cases: a null text has no chunks and stays null; null ids are never removed from and never count as a first place;
chunks repeated inside one document count too; rows that repeat an id count as that id's further places, row by row;
an empty table gives an empty result. Extra columns are carried through inside a struct, so their names clash with none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines in the rolling window.
SPAN = 2
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
ROW = "__row"


def boundaries(hashes: list[int]) -> list[int]:
    """Ends (exclusive) of the chunks of a sequence of line hashes."""
    rolled = []
    for i in range(len(hashes)):
        own = 0
        for h in hashes[max(0, i + 1 - SPAN) : i + 1]:
            own = (own * BASE + h) & MASK
        rolled.append(own * BASE >> 17 & MASK)
    ends = [i + 1 for i, own in enumerate(rolled) if (not i or own > rolled[i - 1]) and (i + 1 == len(rolled) or own > rolled[i + 1])]
    return ends if ends and ends[-1] == len(hashes) else [*ends, len(hashes)] if hashes else []


def chunks(text: str) -> list[str]:
    """The chunks of a text; joined by ``\\n`` they give it again."""
    lines = text.split("\n")
    out, start = [], 0
    for end in boundaries([xxhash.xxh64_intdigest(x.encode()) for x in lines]):
        out.append("\n".join(lines[start:end]))
        start = end
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list[str]] = []
        for text in b.column("__text").to_pylist():
            out.append([] if text is None else chunks(text))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names[:-1], "__chunks"])


def _eligible(chunk: Column) -> Column:
    return chunk.contains("\n") & chunk.rlike(r"[^\x20\x09-\x0D]")


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__chunks`` and a row key ``__row``, written to shared storage (texts once, as their chunks)."""
    kept = docs.select(common.carried(docs, ("text",)).alias("__carry"), "doc_id", F.expr("uuid()").alias(ROW), F.col("text").isNull().alias("__null"), F.col("text").alias("__text"))
    schema = kept.schema
    from pyspark.sql import types as T

    out = T.StructType([*schema.fields[:-1], T.StructField("__chunks", T.ArrayType(T.StringType()))])
    return common.materialise(kept.mapInArrow(_chunked, out), "line-chunks")


def _alike(mine: Column, other: Column) -> Column:
    """How many leading lines two lists of lines share."""
    same = F.zip_with(mine, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def repeats(parts: DataFrame) -> DataFrame:
    """``__row``, ``__place`` of each chunk to remove, and how many lines before and after it go with it.

    Hash pass: 8 bytes a chunk, counted with map-side combine. Only chunks whose hash repeats go on with their bytes and their neighbours'. The
    first place of each text of bytes comes from a second combined aggregate, and joins back on hash and bytes: its side has one
    row a text, and a text that half the corpus shares is split by adaptive skew handling on the other side.
    """
    known = parts.filter(F.col("doc_id").isNotNull())
    hashed = known.select(F.explode("__chunks").alias("__chunk")).filter(_eligible(F.col("__chunk"))).select(F.xxhash64("__chunk").alias("__hash"))
    again = common.materialise(hashed.groupBy("__hash").count().filter("count > 1").select("__hash"), "line-repeated")
    n = F.size("__chunks")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("__chunks", 1, F.greatest(n - 1, F.lit(0))))
    zipped = F.arrays_zip(F.col("__chunks").alias("own"), before.alias("before"), F.slice("__chunks", 2, F.greatest(n - 1, F.lit(0))).alias("after"))
    each = known.select(ROW, "doc_id", F.posexplode(zipped).alias("__place", "__at")).select(ROW, "doc_id", "__place", F.col("__at.own").alias("__chunk"), F.col("__at.before").alias("__before"), F.col("__at.after").alias("__after"))
    each = each.filter(_eligible(F.col("__chunk"))).withColumn("__hash", F.xxhash64("__chunk"))
    bytes_ = each.join(common.maybe_broadcast(again), "__hash", "left_semi")
    first = bytes_.groupBy("__hash", "__chunk").agg(F.min(F.struct("doc_id", "__place", ROW, "__before", "__after")).alias("__first"), F.count("*").alias("__n"))
    first = first.filter("__n > 1").select(F.col("__hash").alias("__fh"), F.col("__chunk").alias("__fc"), "__first")
    found = bytes_.join(first, (F.col("__hash") == F.col("__fh")) & (F.col("__chunk") == F.col("__fc")))
    other = (F.col("__first")[ROW] != F.col(ROW)) | (F.col("__first")["__place"] != F.col("__place"))
    lines = lambda c: F.coalesce(F.split(c, "\n", -1), F.array().cast("array<string>"))
    back = _alike(F.reverse(lines(F.col("__before"))), F.reverse(lines(F.col("__first.__before"))))
    on = _alike(lines(F.col("__after")), lines(F.col("__first.__after")))
    return found.filter(other).select(ROW, "__place", back.alias("__back"), on.alias("__on"))


def left(chunks: list[str], gone: list[tuple[int, int, int]]) -> tuple[str, int]:
    """A text without its removed chunks (place, lines before, lines after), and how many lines went beyond whole chunks."""
    places = {p for p, _, _ in gone}
    head, tail = {}, {}
    for p, back, on in gone:
        head[p + 1] = max(on, head.get(p + 1, 0))
        tail[p - 1] = max(back, tail.get(p - 1, 0))
    out, cut = [], 0
    for i, chunk in enumerate(chunks):
        if i in places:
            continue
        if i in head or i in tail:
            lines = chunk.split("\n")
            kept = lines[head.get(i, 0) : max(head.get(i, 0), len(lines) - tail.get(i, 0))]
            cut += len(lines) - len(kept)
            out += kept
        else:
            out.append(chunk)
    return "\n".join(out), cut


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for null, chunks, gone in zip(*[b.column(c).to_pylist() for c in ("__null", "__chunks", "__gone")], strict=True):
            rows.append((None, 0) if null else left(chunks, [tuple(g.values()) for g in gone or ()]))
        texts, cut = zip(*rows, strict=True) if rows else ((), ())
        counts = [pa.array([len(x or ()) for x in b.column(c).to_pylist()], pa.int64()) for c in ("__chunks", "__gone")]
        yield pa.RecordBatch.from_arrays([b.column("__carry"), pa.array(texts, pa.string()), *counts, pa.array(cut, pa.int64())], names=["__carry", "__left", "__n_chunks", "__n_removed", "__n_cut"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """``__doc``: the row with repeated passages cut from ``text`` (and ``n_chars`` set anew if there); ``__n_chunks``, ``__n_removed``, ``__n_cut``."""
    from pyspark.sql import types as T

    parts = chunked(docs)
    gone = repeats(parts).groupBy(ROW).agg(F.collect_list(F.struct("__place", "__back", "__on")).alias("__gone"))
    both = parts.join(gone, ROW, "left").select("__carry", "__null", "__chunks", "__gone")
    out = T.StructType([both.schema["__carry"], T.StructField("__left", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("__n_chunks", "__n_removed", "__n_cut")]])
    done = both.mapInArrow(_left, out)
    own = {"text": F.col("__left")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.coalesce(F.char_length("__left").cast("long"), F.col("__carry.n_chars"))
    columns = [own[c] if c in own else F.col(f"__carry.`{c}`") for c in docs.columns]
    return done.select(F.struct(*[c.alias(n) for c, n in zip(columns, docs.columns, strict=True)]).alias("__doc"), "__n_chunks", "__n_removed", "__n_cut")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_removed (whole chunks), n_cut (lines beside them), n_left (characters of what is left), text left."""
    out = deduplicate(docs.select("doc_id", "text"))
    chars = F.char_length(F.coalesce("__doc.text", F.lit(""))).cast("long").alias("n_left")
    return out.select("__doc.doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_chunks", "n_removed", "n_cut")], chars, "__doc.text")


def cut(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of ``docs`` only."""
    return deduplicate(docs).select("__doc.*")
