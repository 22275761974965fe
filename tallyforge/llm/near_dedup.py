"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find.

SuperMinHash gives each shingle a random permutation of the signature's places;
in round j a shingle offers j plus a random fraction to its j-th place.  A
document whose places all hold less than j + 1 needs no further round, so a long
document stops after about two.

Documents of the same words in the same order form a class and go on as one.  Documents that
agree on a band of signature rows share a bucket.  Each is compared with the
bucket's smallest document.  Once these links have been joined to components, only
documents of different components that share a bucket remain.  Of these, two that
are linked share one of their rarest shingles (prefix filtering, exact), which a
passage that many documents quote is not among.  By these shingles they are
compared with the smallest document of each other component while that joins
anything, and at last with all others.  So a bucket of n copies costs n
comparisons, and no link is left out for the size of a bucket.  Keys that many documents
have are dealt to several tasks.

Hashes only propose: classes are told apart by 128-bit BLAKE2 digests of the words, and
a link that the hashes of two sets show is confirmed on the shingles themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACED, Words, cut, give_back, mix, segments, spread_join, words
from tallyforge.llm.components import components

#: Places of signatures that shingles permute at once, unless one document has more: short documents keep them all open.
PERMUTED = 4 << 20
_U = np.uint64
_DOC_BITS = _U(54)
_LOW = _U((1 << 54) - 1)


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and their documents; a document of fewer words is one shingle."""
    return _runs(words(texts, SPACED, lower=True), size)


def _runs(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = found.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    hashes, first = found.runs(size)
    of = [doc[first]]
    hashes = [hashes]
    for n in range(1, size):
        if (counts == n).any():
            h, first = found.runs(n)
            short = counts[doc[first]] == n
            hashes.append(h[short])
            of.append(doc[first[short]])
    return np.concatenate(hashes), np.concatenate(of)


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The set of a text itself.  bytes.lower() and bytes.split() know A-Z and ASCII white space only."""
    own = (text or "").encode().lower().split()
    return set(zip(*(own[i:] for i in range(size)))) if len(own) >= size else {tuple(own)} - {()}


def superminhash(items: np.ndarray, doc: np.ndarray, docs: int, places: int) -> np.ndarray:
    """A row of ``places`` values for each document, from its distinct items.  No items: the largest value everywhere."""
    sig = np.full(docs * places, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []
    perm = None
    for j in range(places):
        x = mix(items + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = (j + ((x >> _U(32)) * _U(places - j) >> _U(32)).astype(np.int64)).astype(np.int32)
        if perm is None:
            at = k
            for i in range(j - 1, -1, -1):
                at = np.where(at == swaps[i], np.int32(i), np.where(at == i, swaps[i], at))
            swaps.append(k)
        else:
            rows = np.arange(len(items))
            at = perm[rows, k]
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * places + at, (x & _U(0xFFFFFFFF)) | _U(j << 32))
        open_ = (sig.reshape(docs, places).max(1) >= _U((j + 1) << 32))[doc]
        if not open_.any():
            break
        if perm is not None:
            perm = perm[open_]
        items, doc, swaps = items[open_], doc[open_], [s[open_] for s in swaps]
        if j == 3:
            perm = np.tile(np.arange(places, dtype=np.int32), (len(items), 1))
            rows = np.arange(len(items))
            for i, s in enumerate(swaps):
                perm[rows, s], perm[:, i] = perm[:, i].copy(), perm[rows, s]
            swaps = []
    return sig.reshape(docs, places)


def signatures(items: np.ndarray, n: np.ndarray, places: int) -> np.ndarray:
    """``superminhash`` of documents of ``n`` items each, that stand in order, for some documents at a time."""
    upto, i, out = np.append(0, np.cumsum(n)), 0, [np.zeros((0, places), np.uint64)]
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PERMUTED // places, "right")) - 1)
        out.append(superminhash(items[upto[i] : upto[j]], np.repeat(np.arange(j - i), n[i:j]), j - i, places))
        i = j
    return np.concatenate(out)


def band_plan(percent: int, rows: int = 5, missed: float = 1e-9) -> int:
    """Bands of ``rows`` rows such that a pair just at the threshold shares none with a chance of ``missed`` at most."""
    return max(1, math.ceil(math.log(missed) / math.log(1 - min(0.999999, percent / 100) ** rows)))


def _sign(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i, j in segments(texts):
                found = words(texts[i:j], SPACED, lower=True)
                hashes, doc = _runs(found, size)
                items = np.unique((doc.astype(np.uint64) << _DOC_BITS) | (hashes >> _U(10)))
                n = np.bincount((items >> _DOC_BITS).astype(np.int64), minlength=j - i)
                items = mix(items & _LOW)
                line, start, end = found.joined()
                start, end = np.append(start, len(line)), np.append(0, end)
                own = zip(start[found.bounds[:-1]].tolist(), end[found.bounds[1:]].tolist(), strict=True)
                class_of = np.frombuffer(b"".join(hashlib.blake2b(line[x:y], digest_size=16).digest() for x, y in own), np.int64).reshape(-1, 2)
                sig = signatures(items, n, bands * rows).reshape(j - i, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (j - i, bands)).copy()
                for r in range(rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, r])
                have = np.repeat(n > 0, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(key.ravel()[have].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(class_of[:, k]) for k in (0, 1)), lists], ["doc", "n_shingles", "class_a", "class_b", "bands"])
        give_back()

    return sign


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(size: int, percent: int):
    def close(n: int, m: int, shared: int) -> bool:
        return n > 0 and m > 0 and 100 * shared >= percent * (n + m - shared)

    def sets(texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i, j in segments(texts):
            hashes, doc = shingle_hashes(texts[i:j], size)
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(j - i + 1))
            hashes = hashes[order]
            out += [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in segments(batch.column(2)):
                part = batch.slice(i, j - i)
                texts, others = (part.column(k).fill_null("") for k in (2, 3))
                coded = others.dictionary_encode()  # a bucket's smallest document comes again and again
                right, at = sets(coded.dictionary), coded.indices.to_pylist()
                linked, held, other = [], None, set()
                for k, left in enumerate(sets(texts)):
                    fits = close(len(left), len(right[at[k]]), _shared(left, right[at[k]]))
                    if fits:
                        if held != at[k]:
                            held, other = at[k], shingles(others[k].as_py(), size)
                        own = shingles(texts[k].as_py(), size)
                        fits = close(len(own), len(other), len(own & other))
                    linked.append(fits)
                yield part.filter(pa.array(linked, pa.bool_())).select(["a", "b"])
        give_back()

    return verify


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    A-Z are lower-cased and words are runs of characters other than ASCII white
    space.  A document's set holds its distinct runs of ``shingle`` words, or all
    its words as one run if they are fewer.  Documents are linked if
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id
    that is reached over links.

    A null or empty text has an empty set and is linked with nothing.  Rows that
    share an id are one document of several texts.  A row without an id is linked
    with nothing, has a null ``component_id`` and is kept.  Other columns of
    ``docs`` are not returned.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    bands = band_plan(percent, rows)
    signed = cut(docs.mapInArrow(_sign(shingle, bands, rows), "doc long, n_shingles long, class_a long, class_b long, bands array<long>"), "signatures")
    whole = signed.where("n_shingles > 0 and doc is not null")
    classes = whole.groupBy("class_a", "class_b").agg(F.min(F.struct("doc", "bands")).alias("first"))
    spread = cut(classes.select(F.col("first.doc").alias("doc"), F.col("first.bands").alias("bands")), "classes").select("doc", F.explode("bands").alias("band"))
    heads = spread.groupBy("band").agg(F.min("doc").alias("head"), F.max("doc").alias("last"), F.count("*").alias("n"))
    heads = cut(heads.where("head < last").drop("last"), "heads")
    shared = cut(spread_join(spread, heads.drop("n"), "band", "doc", heads.select("band", "n")).select("band", "doc", "head"), "buckets")
    texts = cut(docs.join(shared.select("doc").distinct(), "doc", "left_semi"), "candidates")
    member = cut(_members(whole.select("doc", "class_a", "class_b")), "members")

    def compare(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verify(shingle, percent), "a long, b long").distinct()

    def pairs_of(frame: DataFrame, a: str, b: str) -> DataFrame:
        return frame.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    tried = cut(pairs_of(shared, "doc", "head"), "pairs")
    # a document of several texts links their classes
    several = member.groupBy("doc").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select("doc")
    links = cut(compare(tried).unionByName(member.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("first").alias("b"))), "links")
    known = _labels(links)
    rest = _mixed(shared.select(F.col("band").alias("key"), "doc"), known)
    keys = cut(_rare_keys(texts, rest.groupBy("doc").agg(F.first("component").alias("component")), shingle, percent), "keys")
    last = False
    while True:
        rest = cut(_mixed(keys, known), "rest")
        others = rest if last else rest.groupBy("key", "component").agg(F.min(F.struct("doc", "n", "rank")).alias("one")).select("key", "component", "one.*")
        others = others.select("key", *(F.col(c).alias(f"other_{c}") for c in ("component", "doc", "n", "rank")))
        # linked sets still have enough in common after the first shingle that they share
        after = F.lit(1) + F.least(F.col("n") - F.col("rank"), F.col("other_n") - F.col("other_rank"))
        met = spread_join(rest, others, "key", "doc").where("component <> other_component").where(after * (100 + percent) >= percent * (F.col("n") + F.col("other_n")))
        new = cut(pairs_of(met, "doc", "other_doc").join(tried, ["a", "b"], "left_anti"), "pairs")
        found = cut(compare(new), "links") if not new.isEmpty() else None
        if found is None or found.isEmpty():
            if last or rest.isEmpty():
                break
            last = True
            continue
        tried, links = tried.unionByName(new), links.unionByName(found)
        known, last = _labels(links), False
    member = member.join(known, F.col("first") == F.col("node"), "left").select("doc", F.coalesce("component", "first").alias("component"))
    label = member.groupBy("doc").agg(F.min("component").alias("component"))
    return signed.select("doc", "n_shingles").join(label, "doc", "left").select(
        F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"), F.coalesce(F.col("component") == F.col("doc"), F.lit(True)).alias("kept")
    )


def _members(whole: DataFrame, parts: int = 1000) -> DataFrame:
    """``doc`` and ``first``, the smallest document of the same class.

    Classes that more than one in ``parts`` of all documents have are fewer than ``parts``, so they are broadcast and
    their documents are not shuffled; the others are joined by their class.
    """
    same = ["class_a", "class_b"]
    firsts = cut(whole.groupBy(*same).agg(F.min("doc").alias("first"), F.count("*").alias("copies")), "classes")
    hot = F.col("copies") * parts > (firsts.agg(F.sum("copies")).first()[0] or 0)
    placed = whole.join(F.broadcast(firsts.where(hot & (F.col("copies") > 1)).select(*same, "first")), same, "left")
    few = placed.where("first IS NULL").drop("first").join(firsts.select(*same, "first"), same)
    return placed.where("first IS NOT NULL").select("doc", "first").unionByName(few.select("doc", "first"))


def _mixed(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``keys``, with their ``component``, whose key documents of different components share."""
    placed = cut(keys.join(known, F.col("doc") == F.col("node"), "left").select(*keys.columns, F.coalesce("component", "doc").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    mixed = cut(mixed.where("lo < hi").select("key", "n"), "mixed")
    return spread_join(placed, mixed.select("key"), "key", "doc", mixed)


def _rare_keys(texts: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``key``, ``doc``, ``n`` and ``rank``: the shingles of which two linked documents share at least one.

    In an order of all shingles from the rarest on, two sets that overlap in
    ``percent`` of the larger one share a shingle among the first
    n - ceil(n * percent / 100) + 1 of each.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in segments(batch.column(1)):
                hashes, doc = shingle_hashes(batch.column(1)[i:j], shingle)
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                hashes, doc = hashes[new], doc[new]
                n = np.bincount(doc, minlength=j - i)[doc]
                for k in range(0, len(doc), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(doc[part])), pa.array(n[part]), pa.array(hashes[part].view(np.int64))], ["doc", "n", "key"])
        give_back()

    each = texts.join(docs.select("doc"), "doc", "left_semi").mapInArrow(shingles, "doc long, n long, key long")
    often = each.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1")
    once = each.join(often, "key")
    of_doc = Window.partitionBy("doc")
    ranked = once.withColumn("rank", F.row_number().over(of_doc.orderBy("docs", "key")) + F.col("n") - F.count("*").over(of_doc))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "doc", "n", F.col("rank").cast("long").alias("rank"))


def _labels(links: DataFrame) -> DataFrame:
    return cut(components(links), "components")
