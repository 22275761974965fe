"""Byte-pair encoding and decoding of whole texts, in batched numpy merge rounds.

The symbols of many words stand in one flat array.  A round looks up all
neighbouring pairs by binary search over the sorted keys of the known pairs, finds
the lowest rank of each word, and merges every place of that pair.  Words without
a known pair leave the array.  Only words that a task has not met are merged; how
they are encoded is remembered, up to a bound of bytes.

The vocabulary is a file of the tokenizers library: a BPE model with the suffix of
word ends, a splitting pattern, byte-level symbols, and lower-casing after NFC.  It
is read on the driver and broadcast (its size is that of the file, two megabytes).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyforge.llm.common import give_back, segments

#: About so many bytes of remembered pieces a task; beyond it the memory starts anew.
REMEMBERED = 40 << 20
_SEGMENT = 1 << 20  # bytes of text that are split at once
_NONE = np.iinfo(np.int64).max
#: Symbols of a word from which its rounds go by rank.
LONG = 2048
_BITS = 20  # of a symbol's number in a pair key
_SPACE = regex.compile("[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
#: str.split() takes these for white space, the vocabulary's pattern does not.
_SEPARATORS = regex.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")
# How the tokenizers library's tables differ from Unicode 15.1, which Python 3.13 has (first and last code points).
# Letters and numbers that its pattern knows besides:
MORE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
MORE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Letters that it lower-cases besides:
MORE_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
# Characters that its normal form neither moves nor composes, as they are younger than its tables:
UNMOVED = [
    (0x898, 0x898), (0x89C, 0x89F), (0x8CA, 0x8CE), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1AC1, 0x1AC2), (0x1AC5, 0x1AC9), (0x1ACB, 0x1ACE),
    (0x1DF6, 0x1DF8), (0x1DFA, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10F48, 0x10F4A), (0x10F4C, 0x10F4C), (0x10F82, 0x10F82), (0x10F84, 0x10F84),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4ED), (0x1E4EF, 0x1E4EF),
]


def _class(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_UNMOVED = regex.compile(f"([{_class(UNMOVED)}])")
_MORE_LOWER = regex.compile(f"[{_class((c, c) for c in MORE_LOWER)}]")


@functools.cache
def _kind(letter: str, more: tuple[tuple[int, int], ...]) -> str:
    """A class of the regex module (its version 1): its own category, less what this Python does not have in it, and ``more``."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    young = [ord(c) for c in regex.findall(rf"\p{{{letter}}}", every) if unicodedata.category(c)[0] != letter]
    runs = np.split(np.array(young), np.flatnonzero(np.diff(young) != 1) + 1)
    gone = _class((int(r[0]), int(r[-1])) for r in runs if len(r))
    return rf"[\p{{{letter}}}--[{gone}]]||[{_class(more)}]" if gone else rf"\p{{{letter}}}||[{_class(more)}]"


def _known(pattern: str) -> str:
    """The vocabulary's pattern, with letters and numbers as the library knows them."""
    letters, numbers = _kind("L", tuple(MORE_LETTERS)), _kind("N", tuple(MORE_NUMBERS))
    for plain, own in ((r"[^\s\p{L}\p{N}]", rf"[^\s||{letters}||{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]")):
        pattern = pattern.replace(plain, own)
    return pattern


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """Symbols, sorted pair keys with ranks, and the splitting of a text into words."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("this is not a vocabulary of lower-cased words with a suffix at word ends")
        self.strings = {i: s for s, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        self.decimals = [str(i) for i in range(max(self.strings) + 1)]
        known, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([known[s] for s in byte_symbols()], np.int64)
        self.last = np.array([known[s + end] for s in byte_symbols()], np.int64)
        pairs = np.array([(known[a], known[b], known[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << _BITS | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), pairs[order, 2]
        self.pattern = regex.compile(_known(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")), regex.V1)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece of text without added tokens, as the pattern finds them."""
        if not piece.isascii():
            piece = "".join(unicodedata.normalize("NFC", x) for x in _UNMOVED.split(piece)).replace("Σ", "σ")  # lower() alone minds a sigma's place
            if _MORE_LOWER.search(piece):
                piece = piece.translate(MORE_LOWER)
        piece = piece.lower()
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,!?;:" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _ranks(self, key: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pair keys (none where they are not of the ``same`` word), and where they stand."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same, self.ranks[at], _NONE), at

    def merge(self, words: list[str]) -> list[bytes]:
        """Symbols of each word after all merges, as 32-bit numbers."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), size)
        rank, at = np.full(len(word), _NONE), np.zeros(len(word), np.int64)  # of the pair of a symbol and the next
        rank[:-1], at[:-1] = self._ranks(symbols[:-1] << _BITS | symbols[1:], word[:-1] == word[1:])
        done_symbols, done_word = [], []
        for i in np.flatnonzero(size > LONG):  # rounds over all symbols would cost the square of its length
            own = word == i
            done_symbols.append(self._merge_long(symbols[own]))
            done_word.append(np.full(len(done_symbols[-1]), i))
        if done_word:
            short = size[word] <= LONG
            symbols, word, rank, at = symbols[short], word[short], rank[short], at[short]
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            open_ = lowest != _NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_word.append(word[~open_])
                symbols, word, rank, at, lowest = symbols[open_], word[open_], rank[open_], at[open_], lowest[open_]
            hit = np.flatnonzero(rank == lowest)
            if not len(hit):
                break
            run = np.cumsum(np.append(True, np.diff(hit) != 1))  # of overlapping places, as in a run of one symbol, every other one
            first = np.flatnonzero(np.diff(run, prepend=0))
            hit = hit[(np.arange(len(hit)) - first[run - 1]) % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word, rank, at = symbols[stay], word[stay], rank[stay], at[stay]
            hit -= np.arange(len(hit))
            near = np.concatenate([hit, hit[hit > 0] - 1])
            after = np.minimum(near + 1, len(symbols) - 1)
            rank[near], at[near] = self._ranks(symbols[near] << _BITS | symbols[after], (word[near] == word[after]) & (near != after))
        if not done_word:
            return [b"" for _ in words]
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        flat = symbols[order].astype(np.int32).tobytes()
        edges = (4 * np.searchsorted(word[order], np.arange(len(raw) + 1))).tolist()
        return [flat[i:j] for i, j in zip(edges, edges[1:])]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one long word after all merges: rounds of the lowest rank as for many words, but a round touches only the places of its rank and their neighbours."""
        n = len(symbols)
        symbols, following, before = np.append(symbols, 0), np.arange(1, n + 2), np.arange(-1, n)
        alive = np.append(np.ones(n, bool), False)
        rank, at = np.full(n + 1, _NONE), np.zeros(n + 1, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def update(place: np.ndarray) -> None:
            rank[place], at[place] = self._ranks(symbols[place] << _BITS | symbols[following[place]], following[place] < n)
            place = place[rank[place] != _NONE]
            place = place[np.argsort(rank[place], kind="stable")]
            for own in np.split(place, np.flatnonzero(np.diff(rank[place])) + 1) if len(place) else []:
                r = int(rank[own[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(own)

        update(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            run = np.cumsum(np.append(True, following[hit[:-1]] != hit[1:]))  # of overlapping places every other one
            first = np.flatnonzero(np.diff(run, prepend=0))
            hit = hit[(np.arange(len(hit)) - first[run - 1]) % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            gone = following[hit]
            alive[gone] = False
            following[hit] = following[gone]
            before[following[hit]] = hit
            left = before[hit]
            update(np.unique(np.concatenate([hit, left[left >= 0]])))
        return symbols[:n][alive[:n]]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class Encoder:
    """Encodes texts; remembers how each piece between white space is encoded."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary, remembered
        self.ids: dict[str, bytes] = {}  # 32-bit numbers, which take an eighth of the memory of Python's
        self.words: dict[str, bytes] = {}
        self.held = 0
        self._forget()

    def _forget(self) -> None:
        self.ids.clear()
        self.words.clear()
        self.held = 0
        self.words |= {x: np.int32(i).tobytes() for x, i in self.vocabulary.added.items()}

    @staticmethod
    def pieces(text: str) -> list[str]:
        return [x for x in _SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def _parts(self, piece: str) -> list[str]:
        """The words and added tokens of a piece; the pattern makes no word that looks like an added token."""
        v = self.vocabulary
        if "<" not in piece or not v.split_added:
            return v.words_of(piece)
        return [w for x in v.split_added.split(piece) if x for w in ([x] if x in v.added else v.words_of(x))]

    def learn(self, split: list[list[str]]) -> set[str]:
        """Encode the pieces that are not yet known; returns them."""
        new = set().union(*split) - self.ids.keys()
        plan = [self._parts(x) for x in new]
        known = self.words
        unknown = list({w for words in plan for w in words if w not in known})
        known.update(zip(unknown, self.vocabulary.merge(unknown), strict=True))
        for piece, words in zip(new, plan, strict=True):
            self.ids[piece] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        self.held += 300 * len(new) + 4 * sum(map(len, new))
        return new

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces))

    def texts(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, all of them known afterwards."""
        if self.held > self.remembered:
            self._forget()
        split = [self.pieces(x) if x else [] for x in texts]
        self.learned = self.learn(split)
        return split


_VOCABULARIES: dict[str, Vocabulary] = {}


def load(content: bytes) -> Vocabulary:
    key = hashlib.sha256(content).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(content)
    return _VOCABULARIES[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with ``n_tokens`` and ``ids``; columns of these names are replaced.

    A null or empty text, or one of white space, has no tokens.  The strings of added tokens
    in a text become those tokens.  Rows are encoded on their own, so repeated rows stay.
    """
    file = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "n_tokens", "ids")]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(file.value))
        for batch in batches:
            *others, texts = batch.columns
            for i, j in segments(texts, _SEGMENT):
                ids = [encoder.encode(pieces) for pieces in encoder.texts(texts[i:j].to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in others), pa.array(n), lists], schema.names)
        del encoder
        give_back()

    return docs.select(*(f.name for f in rest), text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``: the strings of the ids, joined by one space.  Null ids give null, no ids an empty text."""
    file = tokens.sparkSession.sparkContext.broadcast(_content(vocabulary))
    tokens = tokens.drop("decoded")
    names = tokens.columns
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(file.value)
        for batch in batches:
            decoded = [None if x is None else v.decode(x) for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*names, "decoded"])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and digests of the ids and of the decoded text, as ``encode`` and ``decode`` give them.

    ``ids_sha256`` is of the decimal ids joined by one space.  Both digests are made where the
    text is, so that neither ids nor texts leave the task.  Nulls and empty texts are as in ``encode``.
    """
    file = docs.sparkSession.sparkContext.broadcast(_content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(file.value)
        encoder = Encoder(v)
        shown: dict[str, str] = {}
        decoded: dict[str, str] = {}
        for batch in batches:
            texts = batch.column(1)
            for i, j in segments(texts, _SEGMENT):
                n, ids_sha, text_sha = [], [], []
                split = encoder.texts(texts[i:j].to_pylist())
                if len(shown) + len(encoder.learned) != len(encoder.ids):  # it has begun anew
                    shown.clear()
                    decoded.clear()
                for piece in encoder.learned:
                    ids = memoryview(encoder.ids[piece]).cast("i")
                    shown[piece], decoded[piece] = " ".join(map(v.decimals.__getitem__, ids)), v.decode(ids)
                for pieces in split:
                    ids = " ".join(map(shown.__getitem__, pieces))
                    n.append(ids.count(" ") + 1 if pieces else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(" ".join(map(decoded.__getitem__, pieces)).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        del encoder, shown, decoded
        give_back()

    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
