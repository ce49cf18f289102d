"""Operator 9, best-fit packing: a configuration linear program over the length histogram.

Texts are tokenized once into pieces of at most ``SIZE`` ids; only the pieces' lengths reach the driver, as a histogram of at
most ``SIZE`` bins. There the covering LP over configurations (multisets of lengths that fit one sequence) is solved by multiplicative
weights: a length's price falls exponentially with its coverage. One knapsack dynamic programme a round prices the best configuration
through every length; those near the round's best are raised together, until every length is covered or no configuration that fills a
sequence is left. Multiplicities are rounded within the counts, and what remains is placed best fit decreasing, on counts. If best fit of
everything takes fewer sequences than that (the LP says little about a few pieces), it is taken instead. Slots of the plan are dealt to pieces by their rank within their length; ranks are counted per (length,
bucket), so a length that most pieces share is spread over many buckets.

Edge cases: null and empty texts are one piece, id 0 alone; rows repeated or without an id are packed row by row; an empty table
gives an empty result; extra columns are dropped. Pieces of ``SIZE`` ids fill a sequence alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE, END_ID = 2048, 0
#: Multiplicative weights: share of a length's count that a step covers, price decay, how near a round's best price a configuration has to
#: come to be raised, and the share of a sequence that it may leave empty.
STEP, DECAY, LEAST_DECAY, NEAR, WASTE = 0.25, 0.5, 1e-3, 0.1, 1 / 1024
#: Words kept with their ids by each Python worker, the longest kept, and pieces that share a ranking bucket.
KEPT_WORDS, KEPT_BYTES, PER_BUCKET = 1_500_000, 40, 1_000_000
#: Bytes of text tokenized together, and the character that parts new words.
TOGETHER, MARK = 4 << 20, "`"
SPACED_MARK = f" {MARK} ".encode()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts. White space ends every match of the tokenizer's own splitting, so words are looked up one by one.

    New words go through the tokenizer together, parted by ``MARK``, whose id no word without it gives; words that hold it, or a special
    token, and very long ones go through alone. One encoder a Python worker lives on from task to task.
    """

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        common.single_thread()
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.mark = np.array(self._direct(MARK))
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _reset(self) -> None:
        """No words kept. A word is known by 64 bits of hash, in order; it takes about twenty bytes with its ids."""
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.own.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _direct(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        joined = b" ".join(new)
        if MARK.encode() in joined or b"<|" in joined or max(map(len, new), default=0) > KEPT_BYTES:
            odd = {w for w in new if len(w) > KEPT_BYTES or MARK.encode() in w or b"<|" in w}
            new = [w for w in new if w not in odd]
            for w in odd:
                ids = self._direct(w.decode())
                self._keep([w], np.array(ids, np.int64), np.array([len(ids)]))
        for k in range(0, len(new), 51_200):
            part = new[k : k + 51_200]
            texts = [(SPACED_MARK.join(part[j : j + 128]) + SPACED_MARK).decode() for j in range(0, len(part), 128)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)])
            hits, wide = np.ones(len(ids) - len(self.mark) + 1, bool), len(self.mark)
            for j, m in enumerate(self.mark):
                hits &= ids[j : len(ids) - wide + 1 + j] == m
            marks = np.flatnonzero(hits)
            counts = marks - np.r_[0, marks[:-1] + wide]
            self._keep(part, np.delete(ids, (marks[:, None] + np.arange(wide)).ravel()), counts)

    def _keep(self, part: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        h = common.word_hashes(part)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        starts = self.used + np.cumsum(counts) - counts
        self.hashes, self.start, self.count = (np.insert(x, at, y[order]) for x, y in ((self.hashes, h), (self.start, starts), (self.count, counts)))
        self.used += len(ids)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Where words are kept, -1 for those that are not."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1) if len(self.hashes) else np.full(len(h), -1)

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        words, numbers, sizes = common.distinct_words(texts, lower=False)
        h = common.word_hashes(words)
        missing = np.flatnonzero(self._places(h) < 0)
        if len(missing) and len(self.hashes) + len(missing) > KEPT_WORDS:
            self._reset()
            missing = np.arange(len(words))
        self._learn([words[k] for k in missing])
        where = self._places(h)[numbers]
        del words
        count = self.count[where].astype(np.int64)
        ends = np.r_[0, np.cumsum(count)]
        flat = self.flat[np.repeat(self.start[where] - ends[:-1], count) + np.arange(int(ends[-1]))]
        bounds = ends[np.r_[0, np.cumsum(sizes)]].tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.full(b - a + 1, END_ID, "<u4")
            own[:-1] = flat[a:b]
            out.append(own)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            rows: list[tuple] = []
            for k, texts in common.slices(b.column("text"), TOGETHER):
                for row, ids in enumerate(encoder.many(texts), k):
                    rows += [(row, i, a, min(size, len(ids) - a), zlib.crc32(ids[a : a + size].data)) for i, a in enumerate(range(0, len(ids), size))]
                common.give_back()
            row, i, a, n, crc = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(i, pa.int32()), *[pa.array(x, pa.int64()) for x in (a, n, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return common.materialise(cut, "pieces")


def priced(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity, the most that lengths of it together are worth, and the length that was put in last (0: none)."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(price[: size + 1] > 0)
    worth = price[lengths]
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        if k := fits[c]:
            value = best[c - lengths[:k]] + worth[:k]
            j = value.argmax()
            if value[j] > best[c - 1]:
                best[c], last[c] = value[j], lengths[j]
                continue
        best[c] = best[c - 1]
    return best, last


def traced(last: np.ndarray, capacity: int) -> list[int]:
    """The lengths behind the best of a capacity."""
    found, c = [], capacity
    while c > 0:
        if last[c]:
            found.append(int(last[c]))
            c -= int(last[c])
        else:
            c -= 1
    return found


def knapsack(price: np.ndarray, size: int) -> tuple[float, list[int]]:
    """The multiset of lengths, of at most ``size`` together, whose prices sum to the most. price[n]: of length n."""
    best, last = priced(price, size)
    return float(best[size]), traced(last, size)


def solve(counts: dict[int, int], size: int) -> list[tuple[Counter, float]]:
    """Fractional multiplicities of configurations, by multiplicative weights."""
    n = np.zeros(size + 1)
    for length, count in counts.items():
        n[length] = count
    covered = np.where(n > 0, 0.0, 1.0)
    share: dict[tuple, float] = defaultdict(float)
    decay = DECAY
    while (open_ := covered < 1).any():
        price = np.where(open_, np.exp(-decay * covered) * np.arange(size + 1), 0.0)
        best, last = priced(price, size)
        lengths = np.flatnonzero(open_)
        value = price[lengths] + best[size - lengths]
        raised = False
        for k in np.argsort(-value, kind="stable"):
            if value[k] < (1 - NEAR) * best[size]:
                break
            own = Counter([int(lengths[k]), *traced(last, size - int(lengths[k]))])
            if size - sum(i * a for i, a in own.items()) > WASTE * size:
                continue
            step = min(min(max(STEP * n[i], 1.0), (1 - covered[i]) * n[i]) / a for i, a in own.items())
            if step <= 1e-9:
                continue
            share[tuple(sorted(own.elements(), reverse=True))] += step
            for i, a in own.items():
                covered[i] += a * step / n[i]
                covered[i] = 1.0 if covered[i] > 1 - 1e-9 else covered[i]
            raised = True
        if not raised and decay < LEAST_DECAY:
            break
        decay = decay if raised else decay / 2  # the weights' rate falls as the prices close in on those of a full sequence
    return [(Counter(k), x) for k, x in share.items()]


def best_fit(left: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """Best fit decreasing of ``left``, whole groups of like bins at a time."""
    free: dict[int, list[list]] = defaultdict(list)  # space left: groups of [configuration, bins]
    for length in sorted(left, reverse=True):
        n = left[length]
        for space in sorted(s for s in free if s >= length):
            while n and free[space]:
                group = free[space].pop()
                fit = space // length
                full = min(group[1], n // fit)
                if full < group[1]:
                    free[space].append([group[0], group[1] - full])
                if full:
                    free[space - fit * length].append([group[0] + Counter({length: fit}), full])
                    n -= full * fit
                elif n:
                    group = free[space].pop()
                    if group[1] > 1:
                        free[space].append([group[0], group[1] - 1])
                    free[space - n * length].append([group[0] + Counter({length: n}), 1])
                    n = 0
            if not n:
                break
        fit = size // length
        if n // fit:
            free[size - fit * length].append([Counter({length: fit}), n // fit])
        if n % fit:
            free[size - n % fit * length].append([Counter({length: n % fit}), 1])
    return [(c, n) for groups in free.values() for c, n in groups]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[Counter, int]]:
    """Whole multiplicities of configurations that hold exactly ``counts``. Lengths of ``size`` are left out."""
    whole = {k: v for k, v in counts.items() if v and k < size}
    left = dict(whole)
    out = []
    solved = solve(whole, size)
    for round_ in (int, lambda x: int(x + 0.5), math.ceil):  # floors first, then halves and the rest upward, never beyond the counts
        rest = []
        for own, x in sorted(solved, key=lambda p: (-p[1], sorted(p[0].items()))):
            times = min(max(0, round_(x - 1e-9)), *[left[k] // a for k, a in own.items()])
            if times > 0:
                out.append((own, times))
                for k, a in own.items():
                    left[k] -= a * times
            rest.append((own, x - times))
        solved = rest
    out += best_fit({k: v for k, v in left.items() if v}, size)
    plain = best_fit(whole, size)
    return min(out, plain, key=lambda p: sum(times for _, times in p))  # the first if they are equal


def slots(found: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of the first bin, pieces a bin, offset of the first of them), by length and rank."""
    rows, used, base = [], defaultdict(int), 0
    for own, times in found:
        offset = 0
        for length, a in sorted(own.items(), reverse=True):
            rows.append((length, used[length], base, a, offset))
            used[length] += a * times
            offset += a * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _dealt(table: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 50) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 2] + at // row[:, 3], row[:, 4] + at % row[:, 3] * length
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Contract rows, one a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, size)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = slots(plan(counts, size))
    buckets = max(64, sum(counts.values()) // PER_BUCKET)
    short = cut.filter(F.col("length") < size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = short.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))  # `buckets` rows a length
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = short.withColumn("own", own).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    schema = cut.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long"
    packed = ranked.mapInArrow(_dealt(table, size), schema)
    full = cut.filter(F.col("length") >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


score = pack
