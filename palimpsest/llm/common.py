"""What the training-data operators share: the table, words, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: A word of the plain contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


#: Spark's switch for dropping the shuffle files of an execution that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, the optimizer
    knows the table's real size (so it broadcasts small ones only), and the
    shuffle files behind it go, since nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(base: str, *tables: DataFrame) -> str:
    """A column name like ``base`` that none of the tables has (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lists(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from concatenated values and the length of each row."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def pieces_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` bytes of the binary
    or string column (a longer single value is a piece of its own)."""
    values = batch.column(column)
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(values).to_pylist()], np.int64)
    group = np.cumsum(sizes) // most
    start = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


#: Odd multipliers for 64-bit mixing.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S32, S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> S32)) * MIX_B
    h = (h ^ (h >> S29)) * MIX_A
    return h ^ (h >> S32)


class WordHashes(dict):
    """64-bit hash of each word met, forgotten when too many are held."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(a: np.ndarray, k: int, base: np.uint64 = MIX_A) -> np.ndarray:
    """Hash of every ``k`` neighbours of a hashed sequence."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = a[:n].copy()
    for j in range(1, k):
        h *= base
        h += a[j : j + n]
    return mix(h)


#: A random-looking 64-bit value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MIX_A)


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(int(MIX_B), _BLOCK), _powers(pow(int(MIX_B), -1, 1 << 64), _BLOCK)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of several texts, in one array, and where each
    text's words begin in it (with the end). A word is a sum of byte values times
    powers, taken from running sums over blocks of whole words. Different words can
    share a hash: it finds candidates, which have to be compared as words."""
    body = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    space = _SPACE[body]
    turns = np.flatnonzero(np.diff(space, prepend=True))
    start, end = turns[::2], turns[1::2]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        n = int(end[j - 1] - lo)
        up, down = (_UP[:n], _DOWN) if n <= _BLOCK else (_powers(int(MIX_B), n), _DOWN)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[body[lo : lo + n]] * up, out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out), np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
