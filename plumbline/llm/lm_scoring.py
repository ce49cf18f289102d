"""Operator 5, LM scoring with a log-frequency Bloom filter.

N-grams of the training documents are counted in segments of their hashes. A count c is quantised to the level
``1 + floor(log_BASE c)`` and the n-gram enters its segment's Bloom filter once for each level up to its own; asking levels in
turn until one is missing reads the quantised count back; no more levels are asked than the largest count has. Filters always have ``BITS`` bits
an entry, so the rate of false levels (about 1 % a level) does not depend on the size of the corpus. The words' filter is broadcast whole. The
pairs' filter is broadcast whole up to ``MOST_FILTER`` bytes; a larger one goes out in groups of segments of that size, one pass over the
texts a group, and a pass adds the tokens whose pair belongs to its group. Passes give the same score as one filter would.

Probabilities are those of a bigram model with a Witten-Bell escape: ``P(w|h) = ((1-r) c(hw) + (1 + r c(h)) P1(w)) / (1 + c(h))``, r the
share of new types among training bigrams, and P1 add-half unigrams; all c are read from the filter. A text starts and ends
with the end token.

``base_score`` needs exact counts. The ``HEAD`` most frequent words' counts are broadcast (a fixed number); other tokens are sent to
their segment's exact counts, packed as arrays, and partial sums come back to each task's rows.

Edge cases: a null text is empty and scores its end token alone; rows without an id are scored, are held out and teach nothing;
repeated rows count and are scored row by row; with nothing to learn from, probabilities fall back to add-half over one type; an
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIVISOR, HELD = 5, 1
BASE, BITS, PROBES, MOST_FILTER = 1.5, 14, 3, 256 << 20
HEAD, FLUSH, TOGETHER = 1 << 18, 6_000_000, 200_000
END = b"\n"  # no word holds a separator
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.crc_mod(doc_id, DIVISOR) == HELD, F.lit(True))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bigrams(h: np.ndarray, end: np.uint64) -> np.ndarray:
    """Hashes of (previous, this) for each token; the first one's previous is the end token."""
    before = np.r_[end, h[:-1]]
    return mixed(before * MIX + h)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def decoded(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (level * 1.0) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _places(low: np.ndarray, order: int, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a segment's filter an entry lives in, and its bits there."""
    h = mixed(low.astype(np.uint64) * np.uint64(4) + np.uint64(order) + np.uint64(1 << 40) * np.asarray(level, np.uint64))
    at = ((h >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return at.astype(np.int64), bits


class Filter:
    """Segments' filters in one array of 64-bit words; ``first`` has where each starts, and the end. ``most``: the highest level stored."""

    def __init__(self, words: np.ndarray, first: np.ndarray, most: int):
        self.words, self.first, self.n, self.most = words, first, len(first) - 1, most

    @classmethod
    def of(cls, parts: dict[int, bytes], n: int, most: int) -> Filter:
        """The filter of some of ``n`` segments; the others hold nothing."""
        own = [np.frombuffer(parts.get(k, b""), np.uint64) for k in range(n)]
        return cls(np.concatenate([np.zeros(0, np.uint64), *own]), np.r_[0, np.cumsum([len(x) for x in own])], most)

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        segment = common.segment_of(h, self.n)
        base, size = self.first[segment], self.first[segment + 1] - self.first[segment]
        low = h & np.uint64(0xFFFFFFFF)
        out, left, level = np.zeros(len(h), np.int64), np.flatnonzero(size > 0), 1
        while len(left) and level <= self.most:
            at, bits = _places(low[left], order, level, size[left])
            left = left[self.words[base[left] + at] & bits == bits]
            out[left] = level
            level += 1
        return out


def _counted(n: int):
    """Counts of a task by segment: words with whole hashes, bigrams with their low 32 bits."""

    def flushed(words: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        cols: dict[int, list] = {}
        for slot, held in enumerate((words, pairs)):
            h, c = np.unique(np.concatenate(held), return_counts=True)
            segment = common.segment_of(h, n)
            order = np.argsort(segment, kind="stable")
            h, c = h[order], c[order].astype("<u4")
            for s, w in common.split_sorted(segment[order], n):
                once = c[w] == 1  # most bigrams: no count is sent for them
                own = h[w].astype("<u8" if slot == 0 else "<u4")
                cols.setdefault(s, [b""] * 6)[slot * 3 : slot * 3 + 3] = [own[once].tobytes(), own[~once].tobytes(), c[w][~once].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(list(cols), pa.int32()), *[pa.array([v[i] for v in cols.values()], pa.binary()) for i in range(6)]], names=["segment", *PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = common.WordTable(common.word_hashes), common.word_hashes([END])
        words, pairs, size = [], [], 0
        for b in batches:
            for text in b.column("text"):
                h = np.r_[table.of(common.lower_words(text.as_py())), end]
                words.append(h)
                pairs.append(bigrams(h, end[0]))
                size += len(h)
                if size > FLUSH:
                    yield flushed(words, pairs)
                    words, pairs, size = [], [], 0
        if size:
            yield flushed(words, pairs)

    return run


PARTS = ["word_once", "word_more", "word_count", "pair_once", "pair_more", "pair_count"]


def _summed(t: pa.Table, once: str, more: str, count: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = lambda c, d: np.concatenate([np.frombuffer(x, d) for x in t.column(c).to_pylist()])
    single, several = raw(once, kind), raw(more, kind)
    h, at = np.unique(np.r_[single, several], return_inverse=True)
    return h, np.bincount(at, np.r_[np.ones(len(single)), raw(count, "<u4")], len(h)).astype(np.int64)


def _tallied(n: int):
    """A segment's exact word counts, its share of the most frequent words, and its filters."""

    def built(low: np.ndarray, order: int, q: np.ndarray) -> bytes:
        size = int(q.sum()) * BITS // 64 + 1
        own = np.zeros(size, np.uint64)
        for level in range(1, int(q.max(initial=0)) + 1):
            at, bits = _places(low[q >= level], order, level, size)
            np.bitwise_or.at(own, at, bits)
        return own.tobytes()

    def run(t: pa.Table) -> pa.Table:
        words, counts = _summed(t, *PARTS[:3], "<u8")
        pairs, pair_counts = _summed(t, *PARTS[3:], "<u4")
        word_filter = built(words & np.uint64(0xFFFFFFFF), 1, levels(counts))
        pair_filter = built(pairs.astype(np.uint64), 2, levels(pair_counts))
        top = np.argsort(-counts, kind="stable")[: 2 * HEAD // n + 1]
        values = [t.column("segment")[0].as_py(), words.tobytes(), counts.astype("<i8").tobytes(), words[top].tobytes(), counts[top].astype("<i8").tobytes(), word_filter, pair_filter, len(pair_filter), int(levels(np.r_[1, counts, pair_counts]).max()), len(words), int(counts.sum()), len(pairs), int(pair_counts.sum())]
        return pa.Table.from_pydict({f.name: pa.array([v], f.type) for f, v in zip(TALLY, values, strict=True)})

    return run


TALLY = pa.schema([("segment", pa.int32()), *[(k, pa.binary()) for k in ("hashes", "counts", "top", "top_counts", "words", "pairs")], *[(k, pa.int64()) for k in ("pair_bytes", "most", "types", "tokens", "pair_types", "pair_tokens")]])
TALLY_SQL = "segment int, hashes binary, counts binary, top binary, top_counts binary, words binary, pairs binary, pair_bytes long, most long, types long, tokens long, pair_types long, pair_tokens long"
ROWS_SQL = "part int, place int, key long, doc_id {}, held_out boolean, n_tokens long, n_known long, base_score double, score double, segment int, hashes binary, places binary"


def _base(c: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))


def _log_p(m: dict, h: np.ndarray, end: np.uint64, word: np.ndarray) -> np.ndarray:
    """log10 probabilities of tokens whose pair is in the model's group of segments, 0 for the others. word: their counts by the filter."""
    pairs = bigrams(h, end)
    own = m["owned"][common.segment_of(pairs, m["pairs"].n)]
    before = np.r_[word[-1:], word[:-1]][own]  # the last token is an end
    first = (word[own] + 0.5) / (m["tokens"] + 0.5 * (m["types"] + 1))
    pair = decoded(m["pairs"].levels(pairs[own], 2))
    out = np.zeros(len(h))
    out[own] = np.log10(((1 - m["escape"]) * np.minimum(pair, before) + (1 + m["escape"] * before) * first) / (1 + before))
    return out


def _held(texts) -> Iterator[list[list[bytes]]]:
    """Runs of texts of about ``TOGETHER`` tokens, each as its words and the end token."""
    held, n = [], 0
    for text in texts:
        held.append([*common.lower_words(text.as_py()), END])
        n += len(held[-1])
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def _more(shared):
    """A further pass: what the tokens of another group of segments add to each row's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end = shared.value, common.word_hashes([END])
        table = common.WordTable(lambda words: np.stack([h := common.word_hashes(words), m["words"].levels(h, 1).astype(np.uint64)], axis=1), 300_000)
        for b in batches:
            sums = []
            for texts in _held(b.column("text")):
                h, level = table.of([w for x in texts for w in x]).T
                p = _log_p(m, h, end[0], decoded(level.astype(np.int64)))
                sums.append(np.add.reduceat(p, np.cumsum([0, *[len(x) for x in texts[:-1]]])))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.concatenate([np.zeros(0), *sums]))], names=["key", "more"])

    return run


def _scored(n: int, shared):
    """A row for each document, without the share of its rare tokens, and those tokens' hashes packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end = common.word_hashes([END])
        part, place = TaskContext.get().partitionId(), 0
        tokens, types = m["tokens"], m["types"]
        names = [x.split()[0] for x in ROWS_SQL.split(", ")]
        wanted: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def asked() -> pa.RecordBatch:
            h, at = (np.concatenate(x) for x in zip(*wanted, strict=True))
            segment = common.segment_of(h, n)
            order = np.argsort(segment, kind="stable")
            found = list(common.split_sorted(segment[order], n))
            h, at, k = h[order].astype("<u8"), at[order].astype("<u4"), len(found)
            cols = [pa.array([part] * k, pa.int32()), *[pa.nulls(k, t) for t in kinds[1:9]], pa.array([s for s, _ in found], pa.int32()), *[pa.array([x[w].tobytes() for _, w in found], pa.binary()) for x in (h, at)]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def learnt(words: list[bytes]) -> np.ndarray:
            """Of each word: its hash, its level as a count, and its share of the base score if it is frequent, else not a number."""
            h = common.word_hashes(words)
            at = np.searchsorted(m["head"], h)
            at[at == len(m["head"])] = 0
            base = np.full(len(h), np.nan)
            if len(m["head"]):
                base = np.where(m["head"][at] == h, _base(m["head_counts"][at], tokens, types), np.nan)
            return np.stack([h, m["words"].levels(h, 1).astype(np.uint64), base.view(np.uint64)], axis=1)

        table = common.WordTable(learnt, 300_000)

        def scored(texts: list[list[bytes]], place: int) -> list[tuple]:
            """Texts, each ended by the end token, scored as one sequence: the token before a text is the end of the one before."""
            starts = np.cumsum([0, *[len(x) for x in texts[:-1]]])
            h, level, base = table.of([w for x in texts for w in x]).T
            word, base = decoded(level.astype(np.int64)), base.copy().view(np.float64)
            p = _log_p(m, h, end[0], word)
            rare = np.isnan(base)
            if rare.any():
                wanted.append((h[rare], (place + np.repeat(np.arange(len(texts)), [len(x) for x in texts]))[rare]))
            sums = [np.add.reduceat(x, starts) for x in ((~rare).astype(np.int64), np.where(rare, 0.0, base), p)]
            return [(len(x), *row) for x, *row in zip(texts, *[s.tolist() for s in sums], strict=True)]

        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [pa.int32(), pa.int32(), pa.int64(), b.column("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            out: list[tuple] = []
            for held in _held(b.column("text")):
                out += scored(held, place + len(out))
            size = sum(len(x[0]) for x in wanted)
            k = len(out)
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array(range(place, place + k), pa.int32()), b.column("key"), b.column("doc_id"), b.column("held_out"), *[pa.array(c, t) for c, t in zip(cols, kinds[5:], strict=True)], pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 2],
                names=names,
            )
            place += k
            if size > FLUSH:
                yield asked()
                wanted, size = [], 0
        if size:
            yield asked()

    return run


def _answered(tokens: int, types: int):
    """Sums of a segment's rare tokens by task and row, packed."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist()
        hashes = np.frombuffer(rows[0]["hashes"], "<u8") if rows else np.zeros(0, np.uint64)
        counts = np.frombuffer(rows[0]["counts"], "<i8") if rows else np.zeros(0, np.int64)
        out = {"part": [], "places": [], "sums": [], "known": []}
        for part, h, at in zip(*[asked.column(c).to_pylist() for c in ("part", "hashes", "places")], strict=True):
            h, at = np.frombuffer(h, "<u8"), np.frombuffer(at, "<u4")
            where = np.searchsorted(hashes, h)
            where[where == len(hashes)] = 0
            c = np.where(hashes[where] == h, counts[where], 0) if len(hashes) else np.zeros(len(h), np.int64)
            place, own = np.unique(at, return_inverse=True)
            out["part"].append(part)
            out["places"].append(place.astype("<u4").tobytes())
            out["sums"].append(np.bincount(own, _base(c, tokens, types)).astype("<f8").tobytes())
            out["known"].append(np.bincount(own, c > 0).astype("<u4").tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in out.items()})

    return run


def _finished(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """A task's rows with the answers added."""
    place = rows.column("place").to_numpy()
    n = int(place.max(initial=-1)) + 1
    sums, known = np.zeros(n), np.zeros(n, np.int64)
    for p, s, k in zip(*[answers.column(c).to_pylist() for c in ("places", "sums", "known")], strict=True):
        at = np.frombuffer(p, "<u4")
        sums[at] += np.frombuffer(s, "<f8")
        known[at] += np.frombuffer(k, "<u4")
    kept = rows.drop_columns(["part", "place"])
    kept = kept.set_column(kept.schema.get_field_index("n_known"), "n_known", pa.array(rows.column("n_known").to_numpy() + known[place]))
    return kept.set_column(kept.schema.get_field_index("base_score"), "base_score", pa.array(rows.column("base_score").to_numpy() + sums[place]))


def grouped(sizes: dict[int, int]) -> list[list[int]]:
    """Segments in groups whose pair filters together take ``MOST_FILTER`` bytes at most (a segment that takes more is alone)."""
    out: list[list[int]] = []
    room = 0
    for segment, size in sorted(sizes.items()):
        if not out or size > room:
            out.append([])
            room = MOST_FILTER
        out[-1].append(segment)
        room -= size
    return out or [[]]


def score(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n = common.spread(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    counted = rows.filter("NOT held_out").select("text").mapInArrow(_counted(n), "segment int, " + ", ".join(f"{x} binary" for x in PARTS))
    tally = common.materialise(counted.groupBy("segment").applyInArrow(_tallied(n), TALLY_SQL), "ngrams")
    words, sizes, heads = {}, {}, []
    totals = dict.fromkeys(("types", "tokens", "pair_types", "pair_tokens"), 0)
    most = 1
    for r in tally.drop("hashes", "counts", "pairs").toLocalIterator():  # 14 bits a word and level, and 2 * HEAD words at most
        words[r["segment"]], sizes[r["segment"]] = r["words"], r["pair_bytes"]
        heads.append((np.frombuffer(r["top"], "<u8"), np.frombuffer(r["top_counts"], "<i8")))
        most = max(most, r["most"])
        for k in totals:
            totals[k] += r[k]
    head, counts = (np.concatenate(x) for x in zip(*heads, strict=True)) if heads else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    top = np.argsort(-counts, kind="stable")[:HEAD]
    top = top[np.argsort(head[top])]
    model = totals | {"words": Filter.of(words, n, most), "head": head[top], "head_counts": counts[top], "escape": totals["pair_types"] / max(1, totals["pair_tokens"])}
    groups = grouped(sizes)

    def shared(k: int):
        """The model with the ``k``th group's pair filter; segments without any pair belong to the first group."""
        own = {r["segment"]: r["pairs"] for r in tally.filter(F.col("segment").isin(groups[k])).select("segment", "pairs").toLocalIterator()}  # MOST_FILTER bytes
        owned = np.isin(np.arange(n), groups[k]) | ((k == 0) & ~np.isin(np.arange(n), list(sizes)))
        return spark.sparkContext.broadcast(model | {"pairs": Filter.of(own, n, most), "owned": owned})

    if len(groups) > 1:
        rows = common.materialise(rows, "lm-texts")  # rows keep their keys from pass to pass
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = common.materialise(rows.mapInArrow(_scored(n, shared(0)), ROWS_SQL.format(kind)), "lm-rows")
    passes = []
    for k in range(1, len(groups)):
        own = shared(k)
        passes.append(common.materialise(rows.select("key", "text").mapInArrow(_more(own), "key long, more double"), "lm-pass"))
        own.destroy()
    asked = both.filter("segment IS NOT NULL").select("segment", "part", "hashes", "places")
    answers = asked.groupBy("segment").cogroup(tally.select("segment", "hashes", "counts").groupBy("segment"))
    answers = answers.applyInArrow(_answered(totals["tokens"], totals["types"]), "part int, places binary, sums binary, known binary")
    own = both.filter("segment IS NULL").select("part", "place", "key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    final = own.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_finished, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    if passes:
        more = reduce(DataFrame.union, passes).groupBy("key").agg(F.sum("more").alias("more"))
        final = final.join(more, "key").withColumn("score", F.col("score") + F.col("more"))
    return final.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
