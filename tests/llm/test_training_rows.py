"""Packing, hard negatives and whitening, against brute force and over odd tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import duck, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellwright.llm import hard_negatives as negatives_module
from cellwright.llm import queries as Q
from cellwright.llm.hard_negatives import hard_negatives
from cellwright.llm.packing import first_fit_decreasing, packed_sequences, place
from cellwright.llm.whitening import whitened

DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(WORDS)


def ids_of(text, end=2):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def checked(pieces, texts, capacity):
    """Every id in one piece, no gaps in documents or sequences; the share of padding."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.row.doc_id].append((p.start, p.length, p.ids, p.doc_tokens))
        seqs[p.sequence_id].append((p.offset, p.length))
    assert set(docs) == set(texts)
    for i, own in docs.items():
        want = np.array(ids_of(texts[i]), "<u4").tobytes()
        assert b"".join(x[2] for x in sorted(own)) == want and all(4 * a == sum(4 * y[1] for y in own if y[0] < a) and len(c) == 4 * b and 4 * n == len(want) for a, b, c, n in own)
    for own in seqs.values():
        assert all(a == sum(y[1] for y in own if y[0] < a) for a, _ in own) and sum(n for _, n in own) <= capacity
    sizes = [sum(n for _, n in own) for own in seqs.values()]
    return sum(capacity - n for n in sizes if n & (n - 1)) / sum(sizes)


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        order, bins = first_fit_decreasing(lengths, 100)
        room = []
        for item, at in zip(order, bins, strict=True):
            want = next((i for i, r in enumerate(room) if r >= lengths[item]), len(room))
            room += [100] * (want == len(room))
            room[want] -= lengths[item]
            assert at == want
        assert (np.diff(lengths[order]) <= 0).all()
        rows = place(lengths, 100, 3)
        assert sorted((int(r[0]), x) for r in rows for x in range(r[1], r[1] + r[2])) == [(i, x) for i, n in enumerate(lengths.tolist()) for x in range(n)]
        fill = np.bincount(rows[:, 3], weights=rows[:, 2]).astype(int)
        assert all(97 <= n <= 100 or n & (n - 1) == 0 for n in fill)


def test_packing(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert checked(packed_sequences(rows, WORDS).collect(), texts, 4096) < 0.005
    # small groups and other lengths of sequences
    assert checked(packed_sequences(rows.repartition(5), WORDS, capacity=256, group=50).collect(), texts, 256) < 0.07


def test_packing_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = {1: None, 2: "", 3: long, 4: "a<|endoftext|>b1 <|startoftext|> <|ENDOFTEXT|>,x", 5: "it'she's 12.5% x y Σ ΑΣ é 漢字", 6: " \n\t ", None: "no id", 7: "́a ́"}
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in texts.items()], "doc_id long, text string, row string, start int")
    assert checked(packed_sequences(frame, WORDS).collect(), texts, 4096) == 0
    assert checked(packed_sequences(frame, WORDS, apart=False).collect(), texts, 4096) == 0
    same = spark.createDataFrame([(1, "one two three")] * 500, "doc_id long, text string")
    assert sorted(p.length for p in packed_sequences(same, WORDS, capacity=4).collect()) == [4] * 500
    assert packed_sequences(frame.where("false"), WORDS).collect() == []
    got = Q.op11_packing(spark, DIR)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r.doc_id: np.array(ids_of(r.text), "<u4") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.ids_crc32 == zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got.collect())


def mined(rows, anchors, k=3, m=4):
    """By sorting all scores."""
    rows = sorted({(i, c, tuple(int(np.floor(256 * v)) for v in x)) for i, c, x in rows if i is not None and c is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)})
    out = []
    for a in (r for r in rows if r[0] in anchors):
        scored = sorted(((-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r) for r in rows if r != a and len(r[2]) == len(a[2])), key=lambda s: (s[0], s[1][0]))
        for s, p in [x for x in scored if x[1][1] == a[1]][:k]:
            near = [x for x in scored if x[1][1] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a[0], p[0], n, x[1][0], -s, -x[0]) for n, x in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("digit, anchors, rows", [(12, 1024, 4096), (7, 8, 120)])
def test_hard_negatives(spark, monkeypatch, digit, anchors, rows):
    for name, value in (("DIGIT", digit), ("ANCHORS", anchors), ("ROWS", rows)):
        monkeypatch.setattr(negatives_module, name, value)
    rng = np.random.default_rng(digit)
    data = [(i, i % 3, [float(v) for v in rng.normal(size=4)]) for i in range(150)]
    # many ties: whole directions, a third of all rows one vector, two lengths
    data += [(200 + i, i % 2, [float(v) for v in rng.integers(-1, 2, 4)]) for i in range(150)] + [(400 + i, i % 4, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    data += [(600 + i, i % 2, [1.0, float(i % 5)]) for i in range(20)] + [(700, None, [1.0] * 4), (701, 1, None), (None, 1, [1.0] * 4), (702, 1, [1.0, None, 1.0, 1.0]), (703, 1, [float("nan")] * 4), (704, 1, [float("inf")] * 4)]
    data += [(800, 1, []), (801, 1, []), (802, 2, [])] + data[:5] + [(3, 2, [9.0, 1.0, 1.0, 1.0])] * 2
    frame = spark.createDataFrame([(*r, 7, 8) for r in data], "vec_id long, label long, embedding array<double>, score long, h long").repartition(7)
    asks = {i for i in range(0, 900, 20)} | {3, 600, 800}
    got = hard_negatives(frame, F.col("vec_id").isin(sorted(asks)), F.col("label"), 3, 4)
    assert sorted(map(tuple, got.collect())) == mined(data, asks)
    assert hard_negatives(frame.where("false"), F.lit(True), F.col("label")).collect() == []
    assert hard_negatives(frame, F.lit(False), F.col("label")).collect() == []


def test_large_whole_numbers(spark):
    data = [(i, i % 2, [float(1 << 17) * (i + 1), 1.0 / (i + 1), -float(1 << 20)]) for i in range(40)]
    frame = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), 3, 4).collect())) == mined(data, range(0, 40, 10))


def test_hard_negatives_as_sql(spark):
    assert rows_of(Q.op12_hard_negatives(spark, DIR).toPandas()) == rows_of(duck(Q.oracle_sql()["op12_hard_negatives"], DIR))


def whole(vec):
    return tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in vec)


def exact_fit(vectors):
    """Count, sums and covariance (divisor n) of the distinct vectors, in whole numbers until the last step."""
    fit = sorted(set(map(whole, vectors)))
    n, sums = len(fit), np.array(fit, object).sum(0)
    t = np.array([n * np.array(x, object) - sums for x in fit], object)
    return n, sums, (t.T @ t / 1).astype(float) / n**3


def check_whitening(got, data, k):
    data = {i: x for i, x in data}
    n, sums, cov = exact_fit(data.values())
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:k]
    assert {r.id for r in got} == set(data) and all(r.n == n and len(r.whitened) == k and r.identity_error < 1e-9 for r in got)
    centred = {i: (n * np.array(whole(x), object) - sums) for i, x in data.items()}
    assert all(int(r.deviation) == (centred[r.id] ** 2).sum() for r in got)
    np.testing.assert_allclose(got[0].explained, values / np.trace(cov), rtol=1e-9)
    c = np.array([centred[r.id] / n for r in got], float)
    basis = np.linalg.lstsq(c, np.array([r.whitened for r in got]), rcond=None)[0]
    np.testing.assert_allclose(np.linalg.norm(basis, axis=0), 1 / np.sqrt(values), rtol=1e-8)
    np.testing.assert_allclose(cov @ basis, basis * values, atol=1e-9 * values[0] * np.abs(basis).max())


def test_whitening(spark):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    frame = spark.read.parquet(f"{DIR}/embeddings.parquet")
    check_whitening(whitened(frame).collect(), rows, 16)
    # a third of all rows one vector: one of the fit list
    hot = [(10_000 + i, rows[0][1]) for i in range(250)]
    check_whitening(whitened(spark.createDataFrame(rows + hot, "vec_id long, embedding array<double>").repartition(9)).collect(), rows + hot, 16)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(3)
    schema = "vec_id long, embedding array<double>, id string, n int"
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan")] * 3), (93, [float("-inf")] * 3), (94, []), (95, [1e300] * 3)]
    data = [(i, [float(v) for v in rng.normal(size=3) * [1, 30, 1000]]) for i in range(60)]
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    check_whitening(whitened(frame(data + bad)).collect(), data, 3)
    # fewer directions than numbers; very unequal ones; beyond 64 bits
    flat = [(i, [float(x), float(x), float(x * x % 11), 5.0]) for i, x in enumerate(range(30))]
    check_whitening(whitened(frame(flat)).collect(), flat, 2)
    steep = [(i, [float(v) for v in rng.normal(size=5) * [1e9, 1e6, 1e3, 30, 1]]) for i in range(80)]
    got = whitened(frame(steep)).collect()
    assert all(len(r.whitened) == 5 and r.identity_error < 1e-6 for r in got)
    huge = [(i, [float(v) for v in rng.normal(size=2) * 1e14]) for i in range(40)]
    check_whitening(whitened(frame(huge)).collect(), huge, 2)
    # lengths apart, repeated rows and null ids stay, no variance gives no rows
    both = whitened(frame([*data, (1000, [1.0, 2.0]), (1001, [2.0, 5.0]), (1001, [2.0, 5.0]), (None, [2.0, 5.0])])).collect()
    assert len(both) == 64 and sorted(r.n for r in both)[:4] == [2] * 4
    assert whitened(frame([(1, [1.0, 2.0])] * 3)).collect() == [] and whitened(frame(bad).where("false")).collect() == []
    out = Q.op13_whitening(spark, DIR)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert out.count() == 16 * 500
