"""Fill-in-the-middle: reorder a text so that a model learns to write what stands between two parts.

The ``Split`` pre-tokenizer of the tokenizers library cuts a text into isolated matches of a pattern; nothing is trained.
It gives their offsets in code points: how many there are is the text's length in units, and the offsets of the
two drawn ranks are where prefix and middle end.

Python runs over Arrow batches, a text at a time.  A text longer than ``PIECE`` code points is cut where
white space follows a word, which is where a unit ends in any case, so that the library never holds the matches of
more than a piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from tallyforge.llm.common import give_back

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle.  None is a part of another, nor begins with what another ends with.
MARKS = ("<P>", "<S>", "<M>")
#: Code points that the pre-tokenizer takes at once, about.
PIECE = 1 << 18
_BORDER = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = ["n", "form", "prefix_chars", "middle_chars", "output"]


def unit_ends(text: str, split: Split, piece: int = PIECE) -> np.ndarray:
    """Where each unit of ``text`` ends, in code points."""
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        cut = _BORDER.search(text, at + piece) if at + piece < len(text) else None
        past = cut.start() if cut else len(text)
        ends.append(np.array([end for _, (_, end) in split.pre_tokenize_str(text[at:past])], np.int64) + at)
        at = past
    return np.concatenate(ends)


def draws(seed: str, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document, from the SHA-256 of the seed and its id."""
    raw = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4], "big") for i in (0, 4, 8, 12))


def reorder(text: str, drawn: tuple[int, int, int, int], split: Split, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in its new order."""
    ends = unit_ends(text, split)
    n = len(ends)
    p, s, m = MARKS
    if not text or any(mark in text for mark in MARKS) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text
    ranks = sorted(d % (n + 1) for d in drawn[:2])
    first, second = (int(ends[r - 1]) if r else 0 for r in ranks)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if drawn[3] % 100 < spm_rate:
        return n, "spm", first, second - first, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, "".join((p, prefix, s, suffix, m, middle))


def _batches(id_col: str, text_col: str, seed: str, rate: int, spm_rate: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(UNIT), "isolated")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held of reordered texts
                part = batch.slice(at, 256)
                pairs = zip(part[id_col].to_pylist(), part[text_col].to_pylist(), strict=True)
                rows = [reorder(text or "", draws(seed, i), split, rate, spm_rate) for i, text in pairs]
                new = dict(zip(_NAMES, zip(*rows, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part[f.name].cast(f.type) for f in out], schema=out)
        give_back()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    A unit is a word with the white space before it, or white space at the end.  ``rate`` of a hundred documents are reordered, of these
    ``spm_rate`` of a hundred with the suffix first; two drawn numbers of units end prefix and middle, so
    each of the three parts may be empty.  The draws depend on the seed and the id alone, so rows of one id are cut at the same
    draws, and a null id draws as the word null.

    A text that is null, empty or holds one of ``MARKS`` stays as it is (null: empty), form plain, with the two lengths null.
    Columns with the names of the new ones are replaced, others stay.
    """
    docs = docs.drop(*_NAMES)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_MADE).fields])
    return docs.mapInArrow(_batches(id_col, text_col, seed, rate, spm_rate, to_arrow_schema(schema)), schema)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, out of its three parts."""
    parts = F.split(output, "|".join(MARKS), -1)
    part = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
