"""Remove byte strings that stand in an earlier document, by suffix arrays.

Equal strings of ``length`` bytes have to meet in one task.  Each such string, a window, is
routed by its minimizer, the gram of ``GRAM`` bytes in it whose hash is smallest (the last of equal ones), and the
neighbouring windows of a text that share a minimizer travel as one string, about 71 bytes for 22 windows.  A task
collects the strings of its share of the minimizers and sorts their suffixes in two stages: those smaller than their
successors directly, the others by scanning the buckets of their first bytes, each suffix placing the one before it.
Windows are equal where neighbours in the suffix array have a common prefix of ``length`` bytes, so bytes decide
and no hash; of each run of equal windows the smallest document counts, and each sender
hears which windows of its strings stand in a smaller one.

The documents are cut into chunks by ranges of their ids, which also order them.  A chunk sends equal strings
once, for its first document that has them, so a passage that stands in a third of all documents costs an entry a
chunk.  Grams that many windows have (``common_grams``, counted over all texts) are taken as minimizers only
where a window has no others, so no task gets all windows with a common phrase.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import buffers, give_back, mix, range_chunks, segments

GRAM = 8
#: Bins that grams are counted in, and how many times the average share a common bin has.
BINS, COMMON = 1 << 20, 8
#: Bytes of text that are hashed at once, strings that are sorted at once, and bytes of strings whose suffixes are.
PIECE, STRINGS, SORTED = 1 << 21, 150_000, 4 << 20
_U = np.uint64
_SENT = "bucket int, chunk int, first long, n long, strings binary"
_CODEC = pa.Codec("zstd", compression_level=3)


# ---- suffix arrays


def _keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, first byte highest; beyond the end zeros."""
    out = np.zeros(len(data) + 8, _U)
    out[: len(data)] = data
    for k in (1, 2, 4):
        out[: len(out) - k] = (out[: len(out) - k] << _U(8 * k)) | out[k:]
    return out[: len(data) + 1]


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that follows; the last is not, as the empty suffix follows it."""
    ends = np.flatnonzero(np.append(data[1:] != data[:-1], True)) if len(data) else np.zeros(0, np.int64)
    up = np.append(data[ends[:-1]] < data[ends[:-1] + 1], False)[: len(ends)]
    return np.repeat(up, np.diff(ends, prepend=-1))


def _sort_directly(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first ``depth`` bytes or some more: eight bytes a round, only among those still equal."""
    first = keys[at]
    order = np.argsort(first)
    at, first = at[order], first[order]
    new = np.append(True, first[1:] != first[:-1])[: len(at)]
    for step in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group, own = np.cumsum(new)[tied], at[tied]
        key = keys[np.minimum(own + step, len(keys) - 1)]
        order = np.lexsort((key, group))
        at[tied] = own[order]
        key = key[order]  # groups stay in place
        new[tied] |= np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    return at


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The positions of ``data`` in the order of their suffixes, by their first ``depth`` bytes at least.

    With ``wanted`` (a flag for each position) only these are sorted, and those that they are induced from: a suffix
    greater than its successor needs the successors up to the next one that is sorted directly.
    """
    n = len(data)
    up = smaller_than_next(data)
    own = np.ones(n, bool)
    if wanted is not None:
        source = np.append(np.where(up, np.arange(n), n), n)
        source = np.minimum.accumulate(source[::-1])[::-1][:-1]  # the next directly sorted suffix, or the end
        at = np.flatnonzero(wanted)
        step = np.zeros(n + 2, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, np.minimum(source[at], n - 1) + 1, -1)
        own = np.cumsum(step[:n]) > 0
    direct = _sort_directly(np.flatnonzero(up & own), _keys(data), depth)
    size = np.bincount(data[own], minlength=256)
    end = np.cumsum(size)
    head = end - size  # of each bucket: where the next induced suffix goes; the directly sorted ones close it
    begin = end - np.bincount(data[direct], minlength=256)
    out = np.empty(int(size.sum()), np.int64)
    at = 0
    for c in np.flatnonzero(begin < end):
        out[begin[c] : end[c]] = direct[at : at + end[c] - begin[c]]
        at += end[c] - begin[c]

    def place(before: np.ndarray) -> None:
        before = before[before >= 0]
        before = before[own[before] & ~up[before]]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        first = first[order]
        counts = np.bincount(first, minlength=256)
        place = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(head, counts)
        out[place] = before[order]
        head[:] += counts

    place(np.array([n - 1]))  # the empty suffix is the smallest
    scanned = end - size
    for c in range(256):
        while scanned[c] < head[c]:  # a run of one byte induces into its own bucket
            block = out[scanned[c] : head[c]]
            scanned[c] = head[c]
            place(block - 1)
        place(out[begin[c] : end[c]] - 1)
    return out if wanted is None else out[wanted[out]]


def adjacent_prefixes(data: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix and the one before it in the order, ``most`` bytes at most; 0 for the first."""
    keys = _keys(data)
    left = len(data) - suffixes
    out = np.zeros(len(suffixes), np.int64)
    open_ = np.arange(1, len(suffixes))
    for step in range(0, most, 8):
        a, b = suffixes[open_ - 1] + step, suffixes[open_] + step
        differ = keys[np.minimum(a, len(data))] ^ keys[np.minimum(b, len(data))]
        same = np.full(len(open_), 8)
        for k in range(8):
            same[(differ >> _U(8 * (7 - k)) != 0) & (same == 8)] = k
        out[open_] += same
        open_ = open_[same == 8]
    out[1:] = np.minimum(out[1:], np.minimum(left[1:], left[:-1]))  # zeros stand beyond the end
    return np.minimum(out, most)


# ---- windows and their strings


def _grams(data: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """A hash of each gram; with ``common`` (a bit for each bin) the hashes of common grams are above all others."""
    keys = _keys(data)
    n = max(len(data) - GRAM + 1, 0)
    h = mix(keys[:n] + mix(keys[GRAM - 8 : GRAM - 8 + n]))
    return h if common is None else (h >> _U(1)) | np.unpackbits(common)[(h & _U(BINS - 1)).astype(np.int64)].astype(_U) << _U(63)


def _selected(rank: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest rank, by its high bits, among each ``width`` neighbours, the last of equal ones."""
    low = _U(2 * PIECE - 1)  # a piece and a window have fewer positions
    out = (rank & ~low) | (low - np.arange(len(rank), dtype=_U))
    size = 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return (low - (out & low)).astype(np.int64)


@dataclass
class Strings:
    """Neighbouring windows that share a minimizer: where they begin, how many they are, and the minimizer's place and rank."""

    start: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    rank: np.ndarray


def strings(data: np.ndarray, edges: np.ndarray, windows: int, length: int, common: np.ndarray | None) -> Strings:
    """Of the windows that begin before ``windows`` and cross none of ``edges``, where documents begin."""
    n = min(len(data) - length + 1, windows)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Strings(none, none, none, np.zeros(0, _U))
    rank = _grams(data, common)
    chosen = _selected(rank, length - GRAM + 1)[:n]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(edges - length + 1, 0, n), 1)
    np.add.at(step, np.minimum(edges, n), -1)
    inside = np.cumsum(step)[:n] == 0
    turn = np.append(True, chosen[1:] != chosen[:-1])
    begins = inside & (turn | np.append(True, ~inside[:-1]))
    ends = inside & (np.append(turn[1:], True) | np.append(~inside[1:], True))
    start = np.flatnonzero(begins)
    return Strings(start, np.flatnonzero(ends) - start + 1, chosen[start] - start, rank[chosen[start]])


def _rows(data: np.ndarray, found: Strings, part: slice, length: int, buckets: int) -> np.ndarray:
    """Strings as rows of bytes: bucket, windows, place of the minimizer, and the bytes, with zeros up to the longest."""
    width = 2 * length - GRAM
    count = found.count[part]
    bucket = (found.rank[part] % _U(buckets)).astype(">u4")
    body = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[found.start[part]]
    body *= np.arange(width) < (count + length - 1)[:, None]
    return np.concatenate([bucket.view(np.uint8).reshape(-1, 4), np.stack([count, found.gram[part]], 1).astype(np.uint8), body], 1)


@dataclass
class Part:
    """Some strings of neighbouring documents: the documents' data and offsets, the first one's number, and the different rows."""

    first: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    count: np.ndarray
    rows: np.ndarray
    example: np.ndarray
    row: np.ndarray

    def documents(self) -> np.ndarray:
        return self.first + np.searchsorted(self.at, self.start, "right") - 1

    def buckets(self) -> np.ndarray:
        return np.ascontiguousarray(self.rows[:, :4]).view(">u4").ravel().astype(np.int64)


def _parts(texts: pa.Array, length: int, buckets: int, common: np.ndarray | None) -> Iterator[Part]:
    for i, j in segments(texts, PIECE, 1 << 20):
        data, at = buffers(texts[i:j])
        for lo in range(0, max(len(data), 1), PIECE):
            piece = data[lo : lo + PIECE + length - 1]
            found = strings(piece, at[(at > lo) & (at < lo + len(piece))] - lo, PIECE, length, common)
            for k in range(0, max(len(found.start), 1), STRINGS):
                part = slice(k, k + STRINGS)
                rows = _rows(piece, found, part, length, buckets)
                _, example, row = np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
                yield Part(i, data, at, lo + found.start[part], found.count[part], rows[example], example, row)


def _places(bucket: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """A part's rows' numbers among all rows of their buckets that a chunk sends; ``sent``, rows before them, is brought up to date."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
    size = np.diff(edge, append=len(bucket))
    place = np.arange(len(bucket)) - np.repeat(edge, size) + sent[bucket]
    sent[bucket[edge]] += size
    return place


def _pack(rows: np.ndarray, smallest: np.ndarray, length: int) -> bytes:
    """Rows without their buckets and padding, and the rank of the first document of each; before all, how many bytes they are."""
    size = rows[:, 4].astype(np.int64) + length - 1
    raw = smallest.astype("<i4").tobytes() + rows[:, 4].tobytes() + rows[:, 5].tobytes() + rows[:, 6:][np.arange(rows.shape[1] - 6) < size[:, None]].tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(blob: bytes, n: int) -> tuple[np.ndarray, ...]:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, np.uint8, n, 4 * n), np.frombuffer(raw, np.uint8, n, 5 * n), np.frombuffer(raw, np.uint8, -1, 6 * n)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "first": pa.int64(), "n": pa.int64(), "strings": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())})


# ---- what chunks send and hear


def _ordered(docs: pa.Table, id_col: str) -> tuple[pa.Table, np.ndarray]:
    """The documents of a chunk by id, null ids first, and the rank of each one's id."""
    docs = docs.sort_by([(id_col, "ascending")])
    nulls = docs[id_col].null_count
    docs = pa.concat_tables([docs.slice(len(docs) - nulls), docs.slice(0, len(docs) - nulls)])
    ids = docs[id_col].combine_chunks()[nulls:]
    steps = pa.compute.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    return docs, np.concatenate([np.zeros(nulls, np.int64), np.cumsum(np.append(1, steps))[: len(ids)]])


def _send(length: int, buckets: int, common: np.ndarray | None, id_col: str, text_col: str, most: int = 4):
    def send(docs: pa.Table) -> pa.Table:
        give_back()
        docs, rank = _ordered(docs.select([id_col, text_col, "chunk"]), id_col)
        chunk, sent, held, out = docs["chunk"][0].as_py(), np.zeros(buckets, np.int64), [], []

        def flush() -> None:
            rows, smallest, place = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)] if len(order) else []
            for x, y in itertools.pairwise(edges):
                own = order[x:y]
                out.append((int(bucket[own[0]]), chunk, int(place[own[0]]), y - x, _pack(rows[own], smallest[own], length)))
            held.clear()

        for part in _parts(docs[text_col].combine_chunks(), length, buckets, common):
            held.append((part.rows, rank[part.documents()[part.example]], _places(part.buckets(), sent)))
            if len(held) == most:
                flush()
        if held:
            flush()
        return _table(out)

    return send


def _hashed(body: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each of ``begin``."""
    out = np.zeros(len(begin), _U)
    for k in [*range(0, size - 4, 4), size - 4]:
        four = np.zeros(len(begin), _U)
        for b in range(4):
            four = four << _U(8) | body[begin + (k + b)]
        out = mix(out + four + _U(k + 1))
    return out


def _worth_sorting(body: np.ndarray, start: np.ndarray, count: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """Strings that may share a window with another.

    Equal windows have an equal gram at an equal place, and of the other bytes at least half stand on one side of it.
    """
    half = (length - GRAM) // 2
    out = np.zeros(len(start), bool)
    for offset, has in ((-half, gram >= half), (0, count + length - 1 - gram - GRAM >= half)):
        own = np.flatnonzero(has)
        key = _hashed(body, (start + gram)[own] + offset, GRAM + half)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[own[order[1:][same]]] = True
        out[own[order[:-1][same]]] = True
    return out


def _masks(body: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each string, a bit for each window that a string of a smaller ``key`` has too.

    Equal strings are sorted once, for the smallest of their keys.
    """
    width = int(count.max()) + length - 1
    size = count + length - 1
    rows = np.lib.stride_tricks.sliding_window_view(np.append(body, np.zeros(width, np.uint8)), width)[start]
    rows = np.concatenate([rows * (np.arange(width) < size[:, None]), count[:, None]], 1).astype(np.uint8)  # the count tells zeros of a text from those behind it
    _, example, same = np.unique(rows.view(f"S{width + 1}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(example), np.iinfo(np.int64).max)
    np.minimum.at(least, same, key)
    count, size = count[example], size[example]
    begin = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(example)), size + 1)
    text = np.arange(len(of)) - begin[of]
    data = np.zeros(len(of), np.uint8)  # a zero after each string; as no byte of UTF-8 is 255, one more than a byte is no zero
    data[text < size[of]] = rows[example][np.arange(width + 1) < size[:, None]] + np.uint8(1)
    suffixes = suffix_array(data, length, text < count[of])
    heads = np.flatnonzero(adjacent_prefixes(data, suffixes, length) < length)
    owner = of[suffixes]
    first = np.repeat(np.minimum.reduceat(least[owner], heads), np.diff(heads, append=len(owner)))
    later = np.flatnonzero(first < least[owner])
    masks = np.zeros(len(example), _U)
    np.bitwise_or.at(masks, owner[later], _U(1) << text[suffixes[later]].astype(_U))
    return np.where(key > least[same], ~_U(0), masks[same])


def _compare(length: int):
    """Tells each chunk which windows of its strings stand in a smaller document, a bit for each."""

    def compare(bucket: pa.Table) -> pa.Table:
        give_back()
        ns = bucket["n"].to_numpy()
        rank, count, gram, body = (np.concatenate(x) for x in zip(*(_unpack(b, n) for b, n in zip(bucket["strings"].to_pylist(), ns.tolist(), strict=True)), strict=True))
        count, gram = count.astype(np.int64), gram.astype(np.int64)
        start = np.cumsum(count + length - 1) - count - length + 1
        keep = np.flatnonzero(_worth_sorting(body, start, count, gram, length))
        key = (np.repeat(bucket["chunk"].to_numpy().astype(np.int64) << 32, ns) + rank)[keep]
        start, count, gram = start[keep], count[keep], gram[keep]
        several = int((count + length).sum()) // SORTED + 1  # equal windows have equal grams, so they stay together
        share = (_hashed(body, start + gram, GRAM) % _U(several)).astype(np.int64)
        masks = np.zeros(len(keep), _U)
        for k in range(several):
            own = np.flatnonzero(share == k)
            if len(own):
                masks[own] = _masks(body, start[own], count[own], key[own], length)
        string, mask = keep[masks > 0], masks[masks > 0]
        edges = np.cumsum(ns)
        where = np.searchsorted(string, np.append(0, edges)).tolist()
        out = []
        for s, (b, c, first) in enumerate(zip(*(bucket[x].to_pylist() for x in ("bucket", "chunk", "first")), strict=True)):
            own = slice(where[s], where[s + 1])
            if where[s + 1] > where[s]:
                out.append((b, c, first, where[s + 1] - where[s], (string[own] - (edges[s] - ns[s]) + first).astype("<i8").tobytes() + mask[own].astype("<u8").tobytes()))
        return _table(out)

    return compare


def _heard(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows (bucket, then number in it) in order, and the windows of each that stand earlier."""
    number, mask = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for bucket, n, blob in zip(*(told[c].to_pylist() for c in ("bucket", "n", "strings")), strict=True):
        number.append(np.frombuffer(blob, "<i8", n) + (bucket << 40))
        mask.append(np.frombuffer(blob, "<u8", n, 8 * n))
    number, mask = np.concatenate(number), np.concatenate(mask)
    order = np.argsort(number)
    return number[order], mask[order]


def _remove(length: int, buckets: int, common: np.ndarray | None, id_col: str, text_col: str, out: pa.Schema):
    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        give_back()
        docs, rank = _ordered(docs, id_col)
        known, masks = _heard(told)
        sent = np.zeros(buckets, np.int64)
        new = {"n_bytes": [], "n_removed": [], "removed": [], "kept": []}

        def finish(data: np.ndarray, at: np.ndarray, step: np.ndarray) -> None:
            gone = np.cumsum(step[:-1]) > 0
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = gone[x:y]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                new["n_bytes"].append(y - x)
                new["n_removed"].append(int((edges[:, 1] - edges[:, 0]).sum()))
                new["removed"].append([{"first": a, "past": b} for a, b in edges.tolist()])
                new["kept"].append(data[x:y][~own].tobytes())

        held = None
        for part in _parts(docs[text_col].combine_chunks(), length, buckets, common):
            if held is None or held[0] is not part.data:
                if held:
                    finish(*held)
                held = part.data, part.at, np.zeros(len(part.data) + 1, np.int32)
            bucket = part.buckets()
            number = (bucket << 40) + _places(bucket, sent)
            at = np.minimum(np.searchsorted(known, number), max(len(known) - 1, 0))
            mask = np.where(known[at] == number, masks[at], _U(0)) if len(known) else np.zeros(len(number), _U)
            own = rank[part.documents()]
            mask = np.where(own > own[part.example][part.row], ~_U(0), mask[part.row])  # an earlier document has all of the string
            some = np.flatnonzero(mask)
            start, count, mask = part.start[some], part.count[some], mask[some]
            for k in range(int(count.max(initial=0))):
                begin = start[(mask >> _U(k) & _U(1) > 0) & (count > k)] + k
                held[2][begin] += 1
                held[2][begin + length] -= 1
        if held:
            finish(*held)
        columns = {c: pa.array(v, out.field(c).type) for c, v in new.items()}
        return pa.table([columns[f.name] if f.name in columns else docs[f.name].cast(f.type) for f in out], schema=out)

    return remove


def common_grams(docs: DataFrame, text_col: str) -> np.ndarray:
    """A bit for each bin of grams: whether it has over ``COMMON`` times the average.

    Each task counts its texts' grams and gives the bins that have twice its own average and more than 64; fewer than one bin in
    ``COMMON`` is common, so the driver gets at most 131,072 numbers.  What is common only spreads the work; the result does not depend on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            for i, j in segments(batch[0], 1 << 20, 1 << 20):
                data = buffers(batch[0][i:j])[0]
                for k in range(0, len(data), PIECE):
                    n += np.bincount((_grams(data[k : k + PIECE]) & _U(BINS - 1)).astype(np.int64), minlength=BINS)
        many = np.flatnonzero(n > max(2 * n.sum() / BINS, 64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(many, -1), pa.int32()), pa.array(np.append(n[many], n.sum()), pa.int64())], ["bin", "n"])
        give_back()

    counted = docs.select(text_col).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    least = counted.where("bin < 0").select((COMMON * F.greatest(F.col("n") / BINS, F.lit(1.0))).alias("least"))
    found = counted.where("bin >= 0").join(F.broadcast(least), F.col("n") > F.col("least")).select("bin").collect()
    out = np.zeros(BINS, np.uint8)
    out[[r.bin for r in found]] = 1
    return np.packbits(out)


def remove_repeated(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``removed`` (maximal intervals of bytes) and ``kept``, the bytes that are left.

    A byte of a text in UTF-8 goes if a string of ``length`` bytes covers it that also starts in a document of a smaller id.
    Strings are judged on the input, and none crosses documents.  What is left may begin or end within a character,
    so it is binary.  ``length`` is from 24 to 71.

    Null and empty texts have no bytes.  A null id is smaller than all others; rows of one id are no earlier documents
    of each other.  Columns of ``docs`` with the names of the four new ones, or named ``chunk``, are dropped.
    """
    if not 24 <= length < GRAM + 64:  # a bit for each window of a string
        raise ValueError("the length of repeated strings is from 24 to 71 bytes")
    docs = docs.drop("n_bytes", "n_removed", "removed", "kept", "chunk")
    common = common_grams(docs, text_col)
    chunked, bounds = range_chunks(docs, id_col, text_col, chunk_bytes)
    buckets = 2 * (len(bounds) + 1)
    by_chunk = chunked.groupBy("chunk")
    told = by_chunk.applyInArrow(_send(length, buckets, common, id_col, text_col), _SENT).groupBy("bucket").applyInArrow(_compare(length), _SENT)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_bytes long, n_removed long, removed array<struct<first:long,past:long>>, kept binary").fields])
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_remove(length, buckets, common, id_col, text_col, to_arrow_schema(schema)), schema)
