"""Shared plumbing of the training-data operators: tables, shared storage, tokens, broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast explicitly; larger sides go through a shuffled join.
BROADCAST_ROWS = 100_000

#: Input bytes for each partition of keyed work, and the most partitions that size alone asks for.
PART_BYTES, MOST_PARTS = 128 << 20, 1 << 16

#: The contract's word separators: space and the control characters 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(_forget, own)
    return f"file://{own}"


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and nothing is computed twice.

    The files outlive any executor, so a later stage that is retried finds them again. They lie in a folder of the application's own;
    :func:`forget` removes it once results have been read.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


#: Paths of the tables that the innermost :func:`passing` has to remove.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised inside are removed at its end, but for those handed to the function it gives; an outer one removes these.

    Nothing lazy may leave it that reads a removed table.
    """
    own, kept = [], []
    token = _MADE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._materialised)
        return df

    def every() -> list[str]:
        kept.extend(own)
        return list(own)

    keep.all = every
    try:
        yield keep
    finally:
        _MADE.reset(token)
        remove(spark, [p for p in own if p not in kept])
        if (outer := _MADE.get()) is not None:
            outer += kept


def drop(df: DataFrame) -> None:
    """Remove the table that ``df`` is, if :func:`materialise` gave it."""
    if (path := getattr(df, "_materialised", None)) is not None:
        remove(df.sparkSession, [path])


def is_own(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in this application's folder, however the store writes its name."""
    return f"/plumbline/{spark.sparkContext.applicationId}" in path


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark removes the shuffle files of finished queries then, and else only when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_from(df: DataFrame) -> list[str] | None:
    """Paths that ``df`` reads, also where it is cached; None if it reads anything but files."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        roots = leaf.relation().location().rootPaths()
        out += [roots.apply(i).toString() for i in range(roots.size())]
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Remove all tables that this application has materialised, in whatever store they lie."""
    remove(spark, [_own_dir(spark)])


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. Call it on materialised tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, most: int = 0) -> int:
    """A number of partitions for keyed work: the session's shuffle partitions, or one for each ``PART_BYTES`` that the planner expects of
    ``df`` if those are more; at most ``most``. So segments stay small where the session's number was not raised with the data."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:  # the planner's "unknown" is larger
        n = max(n, min(size // PART_BYTES, MOST_PARTS))
    return min(n, most) if most else n


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), "")


def carried(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of ``df``, without some, as one struct: their names then clash with no name of an operator's own."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns if c not in but])


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def single_thread() -> None:
    """One native thread for each Python worker: the executor's cores are shared out by Spark."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def give_back() -> None:
    """Return freed memory of a Python worker to the system, where its allocator can; it otherwise keeps what its largest batch took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def segment_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` segments unsigned 64-bit hashes belong to; their low 32 bits stay free to tell them apart inside it."""
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def split_sorted(segments: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The segments of a sorted array, and where each stands in it."""
    edges = np.searchsorted(segments, np.arange(n + 1))
    return ((int(s), slice(edges[s], edges[s + 1])) for s in np.flatnonzero(np.diff(edges)))


class WordTable:
    """Numbers for byte words, with values that ``learn(words)`` gives as an array; forgets all beyond ``most`` words."""

    def __init__(self, learn, most: int = 500_000):
        self.learn, self.most = learn, most
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.values = np.asarray(self.learn([]))

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Numbers of the words, good until the next call; ``values`` of them is an array by number."""
        get = self.at.get
        places = [get(w, -1) for w in found]
        if -1 in places:
            if len(self.at) > self.most:
                self.reset()
            new = [w for w in dict.fromkeys(found) if w not in self.at]
            for w in new:
                self.at[w] = len(self.at)
            if len(self.at) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((max(len(self.at), len(self.values)), *self.values.shape[1:]), self.values.dtype)])
            self.values[len(self.at) - len(new) : len(self.at)] = self.learn(new)
            places = [self.at[w] for w in found]
        return np.array(places, np.int64)

    def of(self, found: list[bytes]) -> np.ndarray:
        numbers = self.numbers(found)  # first: it may put another array in place of values
        return self.values[numbers]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)


def lower_words(text: str | None) -> list[bytes]:
    """Words between the separators, A-Z lower-cased: bytes methods touch ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct_words(texts: pa.Array, lower: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts (null: empty), the number of each word in turn, and how many words each text has.

    Arrow splits on the same six characters as the contract, and lower-cases A-Z alone.
    """
    texts = texts.fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    found = coded.dictionary.cast(pa.binary()).to_pylist()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    if b"" in found:  # next to white space at either end of a text
        blank = found.index(b"")
        there = numbers != blank
        offsets = np.r_[0, np.cumsum(there)][offsets]
        numbers = numbers[there]
        found[blank] = found[-1]
        numbers[numbers == len(found) - 1] = blank
        found.pop()
    return found, numbers, np.diff(offsets)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes together, and where each starts."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + size, side="right")))
        yield k, texts.slice(k, upto - k)
        k = upto
