import random

import numpy as np
import pytest

from tallyforge.llm import suffix_dedup


def expected(rows, length):
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for i, t in rows:
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] != i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(sum(x["past"] - x["first"] for x in r.removed) == r.n_removed for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows), key=str)


def corpus():
    draw = random.Random(4)
    word = lambda n, a="abü ": "".join(draw.choice(a) for _ in range(n))
    passage, line = word(90), "=" * 70
    rows = [(i, word(draw.randrange(60)) + (passage[draw.randrange(30) :] if i % 3 else "") + word(20) + (line if i % 4 == 0 else "")) for i in range(60)]
    draw.shuffle(rows)
    rows += [(7, rows[0][1]), (7, rows[0][1]), (100, None), (101, ""), (102, "x" * 700), (103, "xy" * 400), (None, passage), (104, passage + passage), (105, "x" * 300 + "\x00" * 200), (106, "\x00" * 120)]
    return rows


@pytest.mark.parametrize("chunk_bytes", [150, 1 << 20])
@pytest.mark.parametrize("length", [24, 50, 71])
def test_equals_brute_force(spark, chunk_bytes, length):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, kept string").repartition(3)
    got = suffix_dedup.remove_repeated(docs, length, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "removed", "kept"]
    assert found(got) == expected(rows, length)


@pytest.mark.parametrize("shares", [{"PIECE": 64, "STRINGS": 7, "SORTED": 200}, {"BINS": 8, "COMMON": 1}])
def test_pieces_of_texts_and_common_grams_change_nothing(spark, shares, monkeypatch):
    import pyarrow as pa

    for name, value in shares.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows, length, buckets = corpus(), 50, 3
    common = np.packbits(np.array([1, 0, 1, 0, 0, 1, 0, 1], np.uint8)) if "BINS" in shares else None
    ids = sorted({i for i, _ in rows if i is not None})
    chunk = lambda i: 0 if i is None or i < ids[len(ids) // 2] else 1
    tables = [pa.table({"doc_id": pa.array([i for i, _ in own], pa.int64()), "text": pa.array([t for _, t in own], pa.string()), "chunk": pa.array([c] * len(own), pa.int32())}) for c in (0, 1) for own in [[r for r in rows if chunk(r[0]) == c]]]
    sent = pa.concat_tables([suffix_dedup._send(length, buckets, common, "doc_id", "text", most=2)(t) for t in tables])
    own = lambda t, c, k: t.filter(pa.compute.equal(t[c], k))
    told = pa.concat_tables([suffix_dedup._compare(length)(own(sent, "bucket", b)) for b in range(buckets) if own(sent, "bucket", b).num_rows])
    spans = pa.list_(pa.struct([("first", "int64"), ("past", "int64")]))
    out = pa.schema([("doc_id", "int64"), ("n_bytes", "int64"), ("n_removed", "int64"), ("removed", spans), ("kept", "binary")])
    got = pa.concat_tables([suffix_dedup._remove(length, buckets, common, "doc_id", "text", out)(t, own(told, "chunk", c)) for c, t in enumerate(tables)])
    rows_of = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept"]) for r in got.to_pylist()), key=str)
    assert rows_of == expected(rows, length)


@pytest.mark.parametrize("alphabet", [2, 4, 255])
def test_suffix_array_equals_sorted_suffixes(alphabet):
    draw = np.random.default_rng(alphabet)
    for n in [1, 2, 3, 10, 200, 2000]:
        data = draw.integers(0, alphabet, n).astype(np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        got = suffix_dedup.suffix_array(data, n + 8)
        raw = data.tobytes()
        want = sorted(range(n), key=lambda i: raw[i:])
        assert got.tolist() == want
        common = suffix_dedup.adjacent_prefixes(data, got, 30)
        for k in range(1, n):
            a, b = raw[want[k - 1] :], raw[want[k] :]
            size = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert common[k] == min(size, 30)


@pytest.mark.parametrize("alphabet", [2, 4])
def test_suffix_array_of_some_positions(alphabet):
    draw = np.random.default_rng(alphabet)
    for n in [1, 2, 5, 50, 500]:
        data = draw.integers(0, alphabet, n).astype(np.uint8)
        wanted = draw.random(n) < 0.3
        raw = data.tobytes()
        assert suffix_dedup.suffix_array(data, n + 8, wanted).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def test_repeated_bytes():
    data = np.frombuffer(b"aaaaaaaaaabaaaaaaaaaa\x00\x00", np.uint8)
    raw = data.tobytes()
    assert suffix_dedup.suffix_array(data, 40).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_length_has_bounds(spark):
    with pytest.raises(ValueError, match="24 to 71"):
        suffix_dedup.remove_repeated(spark.createDataFrame([], "doc_id long, text string"), 100)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
