"""What the corpus operators share: a shared scratch folder, document ranges, and word hashes.

Words are found and hashed for a whole Arrow batch at a time with numpy, so that
no operator loops over words in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at once; bounds the memory of a Python worker.
SEGMENT_BYTES = 1 << 20

_U = np.uint64
#: Modulus and base of the hashes of runs of words.
_PRIME, _BASE = (1 << 61) - 1, 0x16E8FEB86659FD93
_BLOCK = 1 << 18  # bytes or words that are hashed at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none (a local session, as in tests), a temporary
    folder of this machine becomes its checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: what follows no longer depends on how it was made."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, name: str = "chunk", cells: int = 8) -> tuple[DataFrame, list[float]]:
    """Number ``docs`` by ranges of ``id_col``: a smaller chunk holds smaller ids, and equal ids share a chunk.

    A chunk holds about ``chunk_bytes`` of text, or sqrt(650 * all bytes) where that is more (from 100 GB on at 8 MB),
    so that a pair of chunks has a hundred windows of words on average however large the corpus is.  Approximate
    quantiles over all ids cut them into cells, ``cells`` for each chunk that is to be; the bytes of each cell are
    summed, and neighbouring cells join to chunks.  So long texts of neighbouring ids make more chunks, and only one
    cell can be larger than a chunk.  The driver holds one number a cell.  Null ids go to the first chunk; ids that are no numbers are refused.  A column
    ``name`` is replaced, others stay.  Returns the frame and the inner bounds.
    """
    if id_col in docs.columns and not isinstance(docs.schema[id_col].dataType, T.NumericType):
        raise TypeError(f"ranges of {id_col} need numbers, not {docs.schema[id_col].dataType.simpleString()}")
    docs = docs.drop(name)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunk_bytes = max(chunk_bytes, math.isqrt(650 * size))
    if size <= chunk_bytes:
        return docs.withColumn(name, F.lit(0)), []
    n = cells * math.ceil(size / chunk_bytes)
    number = F.col(id_col).cast("double")
    found = docs.agg(F.percentile_approx(number, [i / n for i in range(1, n)], min(8 * n, 1 << 30))).first()[0] or []
    fine = sorted(set(found))
    each = _numbered(docs.select(number.alias("number"), F.octet_length(text_col).alias("bytes")), "number", fine, "cell")
    sums = {r["cell"]: r["bytes"] or 0 for r in each.groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()}
    bounds, held = [], 0
    for cell, bound in enumerate(fine):  # the cell of this number ends before the bound
        held += sums.get(cell, 0)
        if held and held + sums.get(cell + 1, 0) > chunk_bytes:
            bounds.append(bound)
            held = 0
    key = f"{name}_{uuid.uuid4().hex}"
    return _numbered(docs.withColumn(key, number), key, bounds, name).drop(key), bounds


def _numbered(df: DataFrame, key: str, bounds: list[float], name: str) -> DataFrame:
    """``df`` with how many of the ascending ``bounds`` its ``key`` reaches; a null key reaches none."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    df = df.withColumn(key, F.coalesce(key, F.lit(-math.inf)))
    return Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=key, outputCol=name, handleInvalid="keep").transform(df).withColumn(name, F.col(name).cast("int"))


def spread_join(rows: DataFrame, other: DataFrame, key: str, by: str, counts: DataFrame | None = None, parts: int = 1000, salts: int = 64) -> DataFrame:
    """``rows.join(other, key)`` where no task has all rows of a key that many share.

    Keys of more than one in ``parts`` of ``rows`` are fewer than ``parts``, so they are broadcast.  Their rows are
    dealt by a hash of ``by`` as well, to ``salts`` tasks that each have the other side's rows of the key.
    ``counts`` (``key`` and ``n``) are the numbers of rows by key, if they are known already.  The sides are joined by
    shuffle: Spark takes an exploded side to be as small as the file that it comes from, and would broadcast it.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = cut(counts.where(F.col("n") * parts > rows.count()).select(key, F.lit(True).alias("hot")), "hot")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
    right = other.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return left.join(right.hint("merge"), [key, "salt"]).drop("salt")


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: its Python worker lives on, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call, and need none
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit value over all bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def times(x: np.ndarray, factor: int) -> np.ndarray:
    """Products modulo 2**61 - 1, from those of halves of 32 bits."""
    fh, fl = _U(factor >> 32), _U(factor & 0xFFFFFFFF)
    xh, xl = x >> _U(32), x & _U(0xFFFFFFFF)
    mid, low = xh * fl + xl * fh, xl * fl
    return _reduced(xh * (fh * _U(8)) + (mid >> _U(29)) + ((mid & _U((1 << 29) - 1)) << _U(32)) + (low >> _U(61)) + (low & _U(_PRIME)))


def polynomials(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2**61 - 1 of all runs of ``n`` values: those of a run's halves make that of the run."""
    one = _reduced(values >> _U(3))
    out, size = one, 1
    for bit in bin(n)[3:]:
        out = _reduced(times(out[:-size], pow(_BASE, size, _PRIME)) + out[size:])
        size *= 2
        if bit == "1":
            out = _reduced(times(out[:-1], _BASE) + one[size : size + len(out) - 1])
            size += 1
    return out


#: What stands for a byte at one of the first places of a word.
_VALUES = mix(np.arange(1, (128 << 8) + 1, dtype=np.uint64))


def byte_set(spec: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


#: [^\x20\x09-\x0D]+ are words; every other byte, and so every non-ASCII character, belongs to one.
SPACED = ~byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ are words, after lower-casing A-Z.
LOWER_ALNUM = byte_set(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some documents: byte ranges, hashes, and each document's first word (and the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all runs of ``n`` words of one document, and each run's first word."""
        w = len(self.hash)
        if w < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = np.empty(w - n + 1, np.uint64)
        for i in range(0, len(rolled), _BLOCK):
            rolled[i : i + _BLOCK] = polynomials(self.hash[i : i + _BLOCK + n - 1], n)
        last = np.repeat(self.bounds[1:], self.counts())[: w - n + 1]
        first = np.flatnonzero(np.arange(n, w + 1) <= last)
        return mix(rolled[first] + _U(n)), first

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends (before its space)."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        start = end - size
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[end] = False
        step = np.zeros(len(self.data) + 1, np.int8)
        step[self.start] += 1
        step[self.end] -= 1
        out[inside] = self.data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
        return out.tobytes(), start, end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, and offsets into them; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32) if len(texts) else np.zeros(1, np.int32)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def segments(texts: pa.Array, most: int = SEGMENT_BYTES, most_docs: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    _, at = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, len(texts), i + most_docs)
        yield i, j
        i = j


def words(texts: pa.Array, is_word: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, at = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, _word_hashes(data, start, end), np.searchsorted(start, at))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values that stand for a byte at its place in the word, by blocks of bytes."""
    before, after = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    total, begun = _U(0), 0
    for x in range(0, len(data), _BLOCK):
        y = min(x + _BLOCK, len(data))
        s0, s1 = np.searchsorted(start, (x, y))
        e0, e1 = np.searchsorted(end, (x + 1, y + 1))
        place = np.zeros(y - x, np.int64)
        place[0] = begun
        place[start[s0:s1] - x] = start[s0:s1]
        place = np.maximum.accumulate(place)
        begun = int(place[-1])
        at = (np.arange(x, y) - place) << 8 | data[x:y]
        value = _VALUES[at] if int(at.max()) < len(_VALUES) else mix(at.astype(np.uint64) + _U(1))
        upto = np.cumsum(value, dtype=np.uint64) + total
        before[s0:s1] = upto[start[s0:s1] - x] - value[start[s0:s1] - x]
        after[e0:e1] = upto[end[e0:e1] - 1 - x]
        total = upto[-1]
    return mix(after - before + (end - start).astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to this word."""
    return int(words(pa.array([word])).hash[0])
