"""Operator 10, quality rules: adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Every document gets a handful of measures inside its own row (no explode, no shuffle). Per (language, source) cell a KLL
sketch of each measure is aggregated with map-side combine; cells of few documents take the merged sketches of their
language, and those of small languages the merge of everything. Quartiles from the sketches give outlier fences
``q25 - reach * spread`` and ``q75 + reach * spread``, which are joined back and applied. Each measure is a count over a number of
places n (symbols over characters, say), so a document's spread is the interquartile range of its cell plus what counting alone makes
of the cell's upper quartile in a document of its size, ``sqrt(q75 / n) + 1 / n``. No fence has a constant of its own.

Edge cases: a null text counts as empty (0 words, so it fails the base rule); null language or source forms a cell of its own;
repeated rows and repeated ids are judged row by row; an empty table gives an empty result. Extra columns are carried, and
internal columns are prefixed ``__`` and extra ones travel inside a struct, so that they clash with none.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: measure: the count's column, and that of the places it is a share of
MEASURES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "mean_word": ("word_chars", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
    "shout_ratio": ("n_shouts", "word_chars"),
}
#: Fence reach in spreads, documents a cell needs to have thresholds of its own, and the sketch size.
REACH, LEAST_CELL, SKETCH_K = 6.0, 50, 1024
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable bound over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more, the first included."""

    def marked(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _let(places(s), covered))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def judged(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(marked(k))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), judged)))


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per document: the ``carry`` columns as struct ``__carry``, the base counts ``__n_words`` and so on, and the measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = docs.columns
    step = docs.select(
        common.carried(docs.select(*[F.col(f"`{c}`") for c in carry])).alias("__carry"),
        (F.col("lang") if "lang" in known else F.lit(None).cast("string")).alias("__lang"),
        (F.col("source") if "source" in known else F.lit(None).cast("string")).alias("__source"),
        text.alias("__text"),
        common.words(F.col("text")).alias("__words"),
        worded.alias("__lines"),
    ).select(
        "__carry", "__lang", "__source",
        F.size("__words").cast("long").alias("__n_words"),
        _without(F.col("__text"), " \t\n\x0b\x0c\r").cast("long").alias("__word_chars"),
        (F.char_length("__text") - _without(F.col("__text"), "#*$%&|<>")).cast("long").alias("__n_symbols"),
        (F.char_length("__text") - _without(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("__n_upper"),
        (F.char_length("__text") - _without(F.col("__text"), "!")).alias("__n_shouts"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        repeat_words(F.col("__words")).alias("__n_repeat_words"),
    )
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return step.withColumns({"__base_failed": failed} | {f"__{m}": F.col(f"__{count}") / _places(m) for m, (count, _) in MEASURES.items()})


def _places(measure: str) -> Column:
    return F.greatest(F.col(f"__{MEASURES[measure][1]}"), F.lit(1))


def thresholds(rows: DataFrame) -> DataFrame:
    """Quartiles ``<measure>_q1`` and ``<measure>_q3`` per (language, source), from documents that pass the base rule.

    One pass builds the cell sketches; language and global sketches are merges of those, never a second pass over documents.
    """
    sketch = {m: F.kll_sketch_agg_double(F.col(f"__{m}").cast("double"), SKETCH_K) for m in MEASURES}
    cells = common.materialise(
        rows.filter(~F.col("__base_failed"))
        .groupBy("__lang", "__source")
        .agg(F.count("*").alias("__n"), *[s.alias(f"__k_{m}") for m, s in sketch.items()]),
        "quality-cells",
    )
    merged = [F.kll_merge_agg_double(f"__k_{m}", SKETCH_K).alias(f"__k_{m}") for m in MEASURES]
    langs = cells.groupBy("__lang").agg(F.sum("__n").alias("__n"), *merged)
    whole = cells.agg(F.sum("__n").alias("__n"), *merged)

    def named(df: DataFrame, mark: str) -> DataFrame:
        return df.select(
            *[F.col(c).alias(f"{mark}{c}" if c != "__source" else c) for c in df.columns if not c.startswith("__k_")],
            *[F.col(f"__k_{m}").alias(f"{mark}{m}") for m in MEASURES],
        )

    cell, lang, top = named(cells, "c"), named(langs, "l"), named(whole, "t")
    joined = cell.join(lang, F.col("c__lang").eqNullSafe(F.col("l__lang"))).join(F.broadcast(top))  # top: one row

    def pick(m: str) -> Column:
        enough = lambda n: F.col(n) >= LEAST_CELL
        return F.when(enough("c__n"), F.col(f"c{m}")).when(enough("l__n"), F.col(f"l{m}")).otherwise(F.col(f"t{m}"))

    quart = lambda m, r: F.kll_sketch_get_quantile_double(pick(m), F.lit(r))
    step = joined.select(
        F.col("c__lang").alias("__t_lang"), F.col("__source").alias("__t_source"),
        *[quart(m, r).alias(f"__{m}_{n}") for m in MEASURES for n, r in (("q1", 0.25), ("q3", 0.75))],
    )
    return common.materialise(step, "quality-quartiles")


def inside(measure: str) -> Column:
    """Whether a row of :func:`measured` with its cell's quartiles lies between the fences; so it does if the cell has none."""
    own, lo, hi = F.col(f"__{measure}"), F.col(f"__{measure}_q1"), F.col(f"__{measure}_q3")
    width = REACH * (hi - lo + F.sqrt(hi / _places(measure)) + 1 / _places(measure))
    return F.coalesce(own.between(lo - width, hi + width), F.lit(True))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured`, materialised, with ``__kept``. The fences are joined on their cell: broadcast while they
    are few (checked), else by a shuffled join whose hot cells adaptive execution splits."""
    fences = common.maybe_broadcast(thresholds(rows))
    on = F.col("__lang").eqNullSafe(F.col("__t_lang")) & F.col("__source").eqNullSafe(F.col("__t_source"))
    return rows.join(fences, on, "left").withColumn("__kept", reduce(and_, [inside(m) for m in MEASURES], ~F.col("__base_failed")))


def score(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, the counts, base_failed, kept."""
    rows = common.materialise(measured(docs, ["doc_id"]), "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(rows).select("__carry.doc_id", *[F.col(f"__{n}").alias(n) for n in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are written once with their measures and not shuffled."""
    rows = common.materialise(measured(docs, docs.columns), "quality")
    return judged(rows).filter("__kept").select("__carry.*")
