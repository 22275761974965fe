"""Document fingerprints by winnowing.

Every run of ``gram`` characters has a rolling hash; of each ``window`` of consecutive
hashes the smallest is chosen, the rightmost of equal ones.  Two texts that share
``gram + window - 1`` characters in a row therefore share a fingerprint, and every chosen
hash comes with its position.

To compare each document with its successor, the documents are cut into chunks by ranges
of their ids, and a chunk gets the first document of the next one as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tallyforge.llm.common import give_back, mix, range_chunks, segments

#: Texts that share 31 characters in a row share a fingerprint; of random text two hashes in 17 are chosen.
GRAM, WINDOW = 16, 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20  # hashes that are winnowed at once; positions in a segment take 20 bits
_HIGH = ~_U(_SEGMENT - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of ``gram`` code points; those of a run's halves make that of the run."""
    one = mix(points.astype(np.uint64) + _U(1))
    out, size = one, 1
    for bit in bin(gram)[3:]:
        out = out[:-size] * _U(pow(_BASE, size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[:-1] * _U(_BASE) + one[size : size + len(out) - 1]
            size += 1
    return mix(out)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The minimum of every ``window`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    count = n - window + 1
    return np.minimum(back[:count], ahead[window - 1 : window - 1 + count])


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (of 44 bits) and their positions, in order of position.

    A text of fewer than ``gram`` characters has one hash, of all of it, at 0; one of fewer
    than ``gram + window - 1`` has one window of all its hashes.  An empty text has none.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = code_points(text)
    gram = min(gram, len(points))
    n = len(points) - gram + 1
    window = min(window, n)
    values, positions = [], []
    for i in range(0, n - window + 1, _SEGMENT - window + 1):
        part = gram_hashes(points[i : i + _SEGMENT + gram - 1], gram)
        last = _U(_SEGMENT - 1) - np.arange(len(part), dtype=np.uint64)  # of equal hashes the rightmost is smallest
        least = window_minima(part & _HIGH | last, window)
        least = least[np.append(True, least[1:] != least[:-1])]
        values.append(least >> _U(20))
        positions.append((_U(_SEGMENT - 1) - (least & ~_HIGH)).astype(np.int64) + i)
    value, position = np.concatenate(values), np.concatenate(positions)
    new = np.append(True, position[1:] != position[:-1])
    return value[new], position[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes; two empty sets are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def shown(values: np.ndarray) -> str:
    """Chosen hashes in order, as hexadecimal numbers of eleven digits without separators."""
    raw = values.astype(">u8").tobytes().hex()
    return "".join([raw[i + 5 : i + 16] for i in range(0, len(raw), 16)])


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``other``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with ``hashes`` and ``positions`` of its winnowed fingerprint; columns of these names are replaced.

    A null or empty text has no hashes.  Rows are fingerprinted on their own.
    """
    docs = docs.drop("hashes", "positions")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("hashes array<long>, positions array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col))
            for i, j in segments(texts):
                found = [winnow(x.as_py() or "", gram, window) for x in texts[i:j]]
                lists = [pa.array([f[k].astype(np.int64) for f in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *lists], [*names, "hashes", "positions"])
        give_back()

    return docs.mapInArrow(run, schema)


_COMPARED = pa.schema([("id", "int64"), ("n_chars", "int64"), *((c, "string") for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, "float64") for c in ("near_edited", "near_next")), ("positions", pa.list_(pa.int32()))])


def _compare(gram: int, window: int):
    def compare(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("guest", "ascending"), ("id", "ascending"), ("text", "ascending")])
        none = pa.compute.is_null(chunk["id"])
        if pa.compute.any(none).as_py():  # null ids are the smallest, in their chunk and as a guest of another
            rows = np.lexsort((np.arange(len(none)), ~none.to_numpy(), chunk["guest"].to_numpy()))
            chunk = chunk.take(pa.array(rows))
        ids, texts, guest = chunk["id"], chunk["text"], chunk["guest"].to_pylist()
        rows = []
        give_back()  # what the groups before this one have freed
        text = texts[0].as_py() or ""
        found, at = winnow(text, gram, window)
        for i in range(len(guest)):
            if guest[i]:
                break
            other = texts[i + 1].as_py() or ""
            after, next_at = winnow(other, gram, window)
            changed = edited(text, other)
            new = winnow(changed, gram, window)[0]
            sha = hashlib.sha256(changed.encode()).hexdigest()
            rows.append((ids[i].as_py(), len(text), sha, shown(found), shown(new), likeness(found, new), likeness(found, after), at.astype(np.int32)))
            text, found, at = other, after, next_at
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_COMPARED)], schema=_COMPARED)

    return compare


def compare_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next one's, how alike they are, and ``positions`` of the first.

    The next document is the one of the next larger id, after the last the first.  Null ids
    come before all others; rows of one id follow each other in the order of their texts, null
    texts last.  A null text counts as empty.  A single document is its own successor.  Other
    columns of ``docs`` are not returned.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunked, _ = range_chunks(docs, "id", "text", chunk_bytes)
    # one row of numbers a chunk (with more text chunks grow, so that 100 TB have 400,000): its smallest id, null if it holds one, and the chunk before it
    around = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = chunked.groupBy("chunk").agg(F.min("id").alias("head"), F.count_if(F.col("id").isNull()).alias("nulls"))
    heads = heads.select(F.when(F.col("nulls") == 0, F.col("head")).alias("head"), F.coalesce(F.lag("chunk").over(Window.orderBy("chunk")), F.max("chunk").over(around)).alias("chunk"))
    guests = docs.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).select("id", "text", "chunk", F.lit(1).alias("guest"))
    rows = chunked.select("id", "text", "chunk", F.lit(0).alias("guest")).unionByName(guests)
    return rows.groupBy("chunk").applyInArrow(_compare(gram, window), from_arrow_schema(_COMPARED)).withColumnRenamed("id", id_col)
