"""Remove passages of words that stand earlier in the corpus.

Rabin-Karp hashes (modulo 2**61 - 1) of every window of ``window`` words are counted in
Spark, and the repeated windows of a document merge into maximal removal intervals.

The documents are cut into chunks by ranges of their ids, so that "earlier"
between two chunks is the order of the chunks.  A chunk sends the sorted set of
its window hashes, each hash once, to the task that counts this range of hashes;
that task tells each chunk which of them another chunk has as well, a bit for each.  Hashes only
propose: the chunk sends the BLAKE2 digests of the words of these windows, and gets back
the hashes of those that an earlier chunk has sent too.  What repeats within a chunk is found there, by
hash and digest as well.  So a passage that stands in a third of all documents costs
one entry a chunk, and no task gathers its documents; two windows count as equal
if 61 bits of their hashes and 64 bits of their digests are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import Words, buffers, give_back, range_chunks, segments, words

_SENT = "bucket int, chunk int, n long, hashes binary"
_CHECKED = _SENT + ", digests binary"
_CODEC = "zstd"


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences; the high bytes of all stand together."""
    step = np.diff(sorted_hashes, prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    return pa.Codec(_CODEC).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec(_CODEC).decompress(blob, n * 8, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _windows(texts: pa.Array, window: int) -> np.ndarray:
    found = [words(texts[i:j]).runs(window)[0] for i, j in segments(texts)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _digests(texts: pa.Array, window: int, asked: np.ndarray) -> np.ndarray:
    """Digests of the words of the ``asked`` windows (one flag for each window), a space between them."""
    out, w = [np.zeros(0, np.uint64)], 0
    for i, j in segments(texts):
        found = words(texts[i:j])
        first = found.runs(window)[1]
        first = first[asked[w : w + (n := len(first))]]
        w += n
        data, start, end = found.joined()
        for k in range(0, len(first), 50_000):
            part = first[k : k + 50_000]
            raw = [hashlib.blake2b(data[x:y], digest_size=8).digest() for x, y in zip(start[part].tolist(), end[part + window - 1].tolist(), strict=True)]
            out.append(np.frombuffer(b"".join(raw), np.uint64))
    return np.concatenate(out)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _among(hashes: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(hashes), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, hashes), len(sorted_set) - 1)] == hashes


def _sets(sent: pa.Table) -> list[np.ndarray]:
    return [unpack(b, n) for b, n in zip(sent["hashes"].to_pylist(), sent["n"].to_pylist(), strict=True)]


def _ordered(docs: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """The documents of a chunk in order: by id, null ids first, then by text."""
    docs = docs.sort_by([(id_col, "ascending"), (text_col, "ascending")])
    nulls = pa.compute.is_null(docs[id_col])
    return pa.concat_tables([docs.filter(nulls), docs.filter(pa.compute.invert(nulls))]) if pa.compute.any(nulls).as_py() else docs


def _rows(parts: list[tuple[int, int, np.ndarray]], digests: list[np.ndarray] | None = None) -> pa.Table:
    columns = {
        "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
        "chunk": pa.array([c for _, c, _ in parts], pa.int32()),
        "n": pa.array([len(h) for _, _, h in parts], pa.int64()),
        "hashes": pa.array([pack(h) for _, _, h in parts], pa.binary()),
    }
    return pa.table(columns if digests is None else columns | {"digests": pa.array([d.tobytes() for d in digests], pa.binary())})


def _by_bucket(hashes: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    edges = np.searchsorted(hashes, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist()
    return [(b, slice(i, j)) for b, (i, j) in enumerate(zip(edges, [*edges[1:], len(hashes)], strict=True)) if j > i]


def _send(window: int, buckets: int, text_col: str):
    def send(chunk: pa.Table) -> pa.Table:
        give_back()  # what the groups before this one have freed
        number = chunk["chunk"][0].as_py()
        seen = np.unique(_windows(chunk[text_col].combine_chunks(), window))
        return _rows([(b, number, seen[part]) for b, part in _by_bucket(seen, buckets)])

    return send


def _share(bucket: pa.Table) -> pa.Table:
    """Tells each chunk which of its hashes another chunk has too, as bits in their order."""
    sets = _sets(bucket)
    hashes = np.concatenate(sets)
    shared = np.split(_repeated(hashes), np.cumsum([len(s) for s in sets])[:-1])
    some = [i for i, bits in enumerate(shared) if bits.any()]
    return bucket.take(pa.array(some, pa.int64())).select(["bucket", "chunk", "n"]).append_column("hashes", pa.array([np.packbits(shared[i]).tobytes() for i in some], pa.binary()))


def _propose(window: int, buckets: int, id_col: str, text_col: str):
    """The windows of a chunk that other chunks have by their hashes, with their digests."""

    def propose(docs: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        if not docs.num_rows or not told.num_rows:
            return _rows([], [])
        texts = docs[text_col].combine_chunks()
        hashes = _windows(texts, window)
        seen = np.unique(hashes)
        of = dict(_by_bucket(seen, buckets))
        bits = {b: np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for b, n, x in zip(*(told[c].to_pylist() for c in ("bucket", "n", "hashes")), strict=True)}
        asked = _among(hashes, np.concatenate([seen[of[b]][bits[b]] for b in sorted(bits)]))
        hashes = hashes[asked]
        digests = _digests(texts, window, asked)
        order = np.lexsort((digests, hashes))
        hashes, digests = hashes[order], digests[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (digests[1:] != digests[:-1]))[: len(hashes)]
        hashes, digests = hashes[new], digests[new]
        number, parts = docs["chunk"][0].as_py(), _by_bucket(hashes, buckets)
        return _rows([(b, number, hashes[p]) for b, p in parts], [digests[p] for _, p in parts])

    return propose


def _confirm(bucket: pa.Table) -> pa.Table:
    """Tells each chunk the hashes of its windows that an earlier chunk has too, by hash and digest.

    Of a hash that several windows of the chunk share, only the pairs of hash and digest tell which; they go to ``digests``.
    """
    bucket = bucket.sort_by("chunk")
    sets = _sets(bucket)
    hashes, digests = np.concatenate(sets), np.frombuffer(b"".join(bucket["digests"].to_pylist()), np.uint64)
    several = np.concatenate([_repeated(s) for s in sets])
    order = np.lexsort((digests, hashes))  # stable: equal windows stay in the order of their chunks
    again = (np.diff(hashes[order]) == 0) & (np.diff(digests[order]) == 0)
    later = np.zeros(len(hashes), bool)
    later[order[1:][again]] = True
    rows, pairs, number, at = [], [], bucket["bucket"][0].as_py(), 0
    for chunk, own in zip(bucket["chunk"].to_pylist(), sets, strict=True):
        part = slice(at, at := at + len(own))
        plain, mixed = later[part] & ~several[part], later[part] & several[part]
        if plain.any() or mixed.any():
            rows.append((number, chunk, own[plain]))
            pairs.append(np.stack([own[mixed], digests[part][mixed]], 1))
    return _rows(rows, pairs)


def _covered(found: Words, hashes: np.ndarray, first: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """For each word, whether a repeated window covers it."""
    n = len(found.hash)
    step = np.zeros(n + 1, np.int64)
    step[first[repeated]] += 1
    step[first[repeated] + window] -= 1
    return np.cumsum(step[:-1]) > 0


def _kept(data: bytes, found: Words, d: int, gone: np.ndarray, at: tuple[int, int], reflow: bool) -> tuple[bytes, np.ndarray]:
    """What is left of document ``d``, and the removed intervals of its words."""
    w0, w1 = found.bounds[d], found.bounds[d + 1]
    flags = np.diff(gone[w0:w1].astype(np.int8), prepend=0, append=0)
    lo, hi = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)
    start, end = found.start[w0:w1], found.end[w0:w1]
    pieces, last = [], at[0]
    for i, j in zip(lo, hi, strict=True):
        pieces.append(data[last : start[i]])
        last = at[1] if j == len(start) else int(start[j])
    pieces.append(data[last : at[1]])
    left = b"".join(pieces)
    return (b" ".join(left.split()) if reflow else left.rstrip() if len(lo) and hi[-1] == len(start) else left), np.stack([lo, hi], 1)


def _remove(window: int, id_col: str, text_col: str, reflow: bool, out: pa.Schema):
    def remove(docs: pa.Table, sent: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out.empty_table()
        give_back()
        docs = _ordered(docs, id_col, text_col)
        texts = docs[text_col].combine_chunks()
        hashes = _windows(texts, window)
        elsewhere = _among(hashes, np.sort(np.concatenate([np.zeros(0, np.uint64), *_sets(sent)])))
        pairs = np.frombuffer(b"".join(sent["digests"].to_pylist()), np.uint64).reshape(-1, 2)
        asked = (_repeated(hashes) & ~elsewhere) | _among(hashes, np.unique(pairs[:, 0]))
        # what earlier chunks have stands first, so that of equal windows only a first one of this chunk is fresh
        every = np.append(pairs[:, 0], hashes[asked]), np.append(pairs[:, 1], _digests(texts, window, asked))
        order = np.lexsort(every[::-1])
        first = np.append(True, (np.diff(every[0][order]) != 0) | (np.diff(every[1][order]) != 0))[: len(order)]
        fresh = ~elsewhere
        fresh[np.flatnonzero(asked)] = np.isin(np.arange(len(pairs), len(order)), order[first], assume_unique=True)
        n_words, n_removed, spans, kept, w = [], [], [], [], 0
        for i, j in segments(texts):
            found = words(texts[i:j])
            own, first = found.runs(window)
            gone = _covered(found, own, first, ~fresh[w : w + len(own)], window)
            w += len(own)
            _, at = buffers(texts[i:j])
            counts = found.counts()
            lost = np.concatenate([[0], np.cumsum(gone)])[found.bounds]
            lost = np.diff(lost)
            n_words += counts.tolist()
            n_removed += lost.tolist()
            data = found.data.tobytes()
            for d in range(j - i):
                if lost[d]:
                    text, cut = _kept(data, found, d, gone, (int(at[d]), int(at[d + 1])), reflow)
                    kept.append(text)
                    spans.append([{"first": int(a), "past": int(b)} for a, b in cut])
                else:
                    text = data[at[d] : at[d + 1]]
                    kept.append(b" ".join(text.split()) if reflow else text)
                    spans.append([])
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, out.field("removed").type), "kept_text": kept}
        return pa.table([new[f.name] if f.name in new else docs[f.name].cast(f.type) for f in out], schema=out)

    return remove


def remove_repeated(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", reflow: bool = True, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (intervals of words) and ``kept_text``.

    A word is a run of characters other than ASCII white space.  A word goes if
    a window of ``window`` words covers it whose words also start earlier: in a
    document of a smaller id, or earlier in the same document.  Windows are
    judged on the input.  With ``reflow`` the kept words are joined by one
    space; else the white space between kept words stays as it was.

    Null and empty texts have no words, and their kept text is empty.  A null id
    counts as smaller than all others.  Rows that share an id count as documents
    of their own in the order of their texts.  Columns of ``docs`` with the
    names of the four new ones, or named ``chunk``, are dropped.
    """
    made = ["n_words", "n_removed", "removed", "kept_text"]
    docs = docs.drop(*made, "chunk")
    chunked, bounds = range_chunks(docs, id_col, text_col, chunk_bytes)
    buckets = len(bounds) + 1
    by_chunk = chunked.groupBy("chunk")
    told = by_chunk.applyInArrow(_send(window, buckets, text_col), _SENT).groupBy("bucket").applyInArrow(_share, _SENT)
    proposed = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_propose(window, buckets, id_col, text_col), _CHECKED)
    back = proposed.groupBy("bucket").applyInArrow(_confirm, _CHECKED)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<first:long,past:long>>, kept_text string").fields])
    remove = _remove(window, id_col, text_col, reflow, to_arrow_schema(schema))
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(remove, schema)
