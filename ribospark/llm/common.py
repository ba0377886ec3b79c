"""Shared pieces of the training-data operators: words, row keys and batch plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.plans.runtime import ensure_checkpoint_dir

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: A word of a shingle: letters, digits and marks of any script, case folded by lower(); ASCII text has no marks.
SHINGLE_WORD, ASCII_SHINGLE_WORD = regex.compile(r"[\w\p{M}]+"), re.compile(r"\w+", re.ASCII)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(modulus)


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; its Python worker, which lives on for later tasks, gives freed memory back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def map_batches(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over column dictionaries: ``rows`` gets and yields dicts of column -> list or array."""
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: c for n, c in zip(b.schema.names, b.columns)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(frugal(run), schema)


_PA = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as a column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_limit(share: float) -> int:
    """The signed 64-bit hash up to which about ``share`` of all hashes lie."""
    return 2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63


#: Bits of a key filter as a power of two: 8 MB, whatever the number of keys.
FILTER_BITS = 26


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for 64-bit keys, true for every value in the only column of ``keys`` and by chance for a few others.

    It keeps rows that can't be concerned out of a shuffle; what passes is still to be joined.
    At most 2^FILTER_BITS / 64 rows reach the driver.
    """
    spark, bit = keys.sparkSession, F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.toDF("key").select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def known(asked: pa.Array) -> pa.Array:
        bit = asked.to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
        return pa.array((shared.value[bit >> 6] >> (bit & 63)) & 1 == 1)

    return known


class Stored:
    """A table written once to the shared folder, for readers that would compute it anew each; ``drop`` removes it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{ensure_checkpoint_dir(self.spark)}/stored-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pa_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL such as ``doc_id long, text string``."""
    return pa.schema([pa.field(name, _PA[kind]) for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", "))])


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver by way of Arrow: from a list, Spark would fill them through Python workers of another kind on every executor."""
    target = pa_schema(schema)
    columns = zip(*rows) if rows else [[]] * len(target)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target), schema)


def hash_bytes(data: bytes) -> int:
    """A 64-bit digest of ``data`` as a signed integer."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


class WordHashes(dict):
    """Memo of word -> unsigned 64-bit hash, emptied when it holds ``limit`` words so that memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an unsigned array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER_BYTE = np.array([_ASCII_LOWER.get(i, i) for i in range(256)], np.uint8)
_BYTE_CODE = np.random.default_rng(23).integers(1, 2**63, 256).astype(np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes whose words are hashed together.
_SPAN = 1 << 19


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.full(n, f, np.uint64).cumprod() for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


def word_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, last two bytes, words by text) of the ``WORD`` words of string texts, A-Z lower-cased; null is empty.

    Works on the bytes of the whole column: a word's hash is the difference of two prefix
    sums of a polynomial modulo 2^64 over random byte codes.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or ends[-1] == ends[0]:
        return np.empty(0, np.uint64), np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
    data = _LOWER_BYTE[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = _WORD_BYTE[data]
    first = np.zeros(len(data) + 1, bool)  # a text starts here
    first[ends] = True
    begin = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + _SPAN, side="right")))
        low, high = begin[at], end[stop - 1]
        power, inverse = powers(1 << max(16, int(high - low).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), (_BYTE_CODE[data[low:high]] * power[: high - low]).cumsum()])
            a, z = begin[at:stop] - low, end[at:stop] - low
            hashes[at:stop] = mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64))
        at = stop
    tail = data[end - 1].astype(np.uint16) | np.where(end - begin > 1, data[end - 2], 0).astype(np.uint16) << 8
    return hashes, tail, np.diff(np.searchsorted(begin, ends))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order of position; fewer words than ``size`` give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)


def shingle_words(text: str | None) -> list[str]:
    """The words whose runs make the shingles of a text."""
    return (ASCII_SHINGLE_WORD if text.isascii() else SHINGLE_WORD).findall(text.lower()) if text else []


def crc32_u(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF
