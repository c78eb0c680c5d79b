"""Token encoding and mixing."""

import math

import pytest
from pyspark.sql import functions as F

from graphlens.llm import mixing, tokens

TEXTS = [(1, "Hello  world's 1234\n\n  x"), (2, ""), (3, None), (4, "<|endoftext|> ok"), (5, "日本語 テスト ² Ⅷ ½"), (6, "a" * 5000), (7, "\x1c\x1d a　b\xa0"), (8, "naïve café — “q” 🎉🎉"), (9, "Hello  world's 1234\n\n  x"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, ids string, word string")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("frequent", [0, 5, 2**17])
def test_encode(docs, reference, frequent, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", frequent)
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs).collect()}
    assert got == {i: reference(t) for i, t in TEXTS}
    sizes = {r.doc_id: r.tokens for r in tokens.count_tokens(docs).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


@pytest.mark.parametrize("encode", [tokens.encode, tokens.count_tokens])
def test_batches_come_back_in_parts(docs, reference, encode, monkeypatch):
    import pyarrow as pa

    steps, original = {}, type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *more, **named: steps.update({f.__name__: f}) or original(self, f, *more, **named))
    whole = {r.doc_id: r[-1] for r in encode(docs).collect()}
    ids = [i for i, _ in TEXTS] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in TEXTS] * 1000), pa.array(ids, pa.int64())], names=["_text", "doc_id"])
    parts = list(steps["look_up"]([batch.slice(0, 0), batch, batch.slice(9)]))
    assert len(parts) > 9 and sum(p.nbytes for p in parts) > 4 * max(p.nbytes for p in parts)
    assert [i for p in parts for i in p.column(0).to_pylist()] == ids + ids[9:]
    assert all(x == whole[i] for p in parts for i, x, rare in zip(*(c.to_pylist() for c in p.columns)) if not rare)
    long = pa.RecordBatch.from_arrays([pa.array(["a b" * 2**20, None, "", "c"]), pa.array([1, 2, 3, 4])], names=["_text", "doc_id"])
    assert [p.num_rows for p in tokens._parts([long])] == [1, 3]


def test_decode_and_empty(docs):
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in TEXTS}
    odd = docs.sparkSession.createDataFrame([(1, [999999]), (2, [-1, 5]), (3, None), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(odd).collect()} == {1: None, 2: None, 3: "", 4: ""}
    assert tokens.encode(docs.limit(0)).count() == 0


def test_split_is_lossless():
    split = tokens.splitter()
    for _, t in TEXTS:
        assert "".join(split(t or "")) == (t or "")


def test_capped_poisson():
    for rate, cap in [(0.3, 1), (0.9, 2), (2.5, 8), (0.01, 4)]:
        mean = mixing.mean_for(rate, cap)
        assert math.isclose(mixing.capped_mean(mean, cap), rate, rel_tol=1e-6)
    assert mixing.mean_for(3, 2) == math.inf and mixing.mean_for(0, 2) == 0.0
    offset, steps = mixing.cdf(1.0, 3)
    assert offset == 0 and steps == pytest.approx([0.3679, 0.7358, 0.9197], abs=1e-4)


@pytest.mark.parametrize("rate,cap", [(700, 1000), (700, 701), (5000, 10**6), (999.5, 1000), (3, 10**9)])
def test_large_means(rate, cap):
    mean = mixing.mean_for(rate, cap)
    assert math.isclose(mixing.capped_mean(mean, cap), rate, rel_tol=1e-6)
    offset, steps = mixing.cdf(mean, cap)
    assert len(steps) <= 80 * math.sqrt(mean) + 90 and steps == sorted(steps) and offset + len(steps) <= cap
    draws = [offset + sum(c <= (k + 0.5) / 2000 for c in steps) for k in range(2000)]
    assert max(draws) <= cap and math.isclose(sum(draws) / 2000, rate, rel_tol=0.01)


def test_many_copies_and_clashing_targets(spark):
    sizes = spark.createDataFrame([(1, "few", 10), (2, "few", 10), *((k, "many", 10) for k in range(3, 3003))], "doc_id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("m", "few", 0.5, 1000), ("m", "few", 0.4, 2000), ("m", "few", 0.5, 900), ("m", "many", 0.5, 1)], "mix string, source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.Plan(sizes, targets).shares().collect()}
    assert rows["few"].max_repeats == 1000 and rows["few"].met and abs(rows["few"].share_of_size - 0.5) < 0.03
    assert abs(rows["many"].share_of_size - 0.5) < 0.02


def test_mixing(spark):
    sizes = spark.createDataFrame([(k, "big" if k % 3 else "small", 10 + k % 7) for k in range(6000)] + [(None, "big", 5), (9999, None, 5)], "doc_id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("m", "big", 0.3, 3), ("m", "small", 0.5, 2), ("m", "none", 0.2, 2), ("m", "big", 0.3, 3), ("n", "small", 1.0, 1), ("m", None, 0.1, 1), ("bad", "big", 0.0, 1)], "mix string, source string, target_share double, max_repeats int")
    plan = mixing.Plan(sizes, targets)
    rows = {(r.mix, r.source): r for r in plan.shares().collect()}
    assert set(rows) == {("m", "big"), ("m", "small"), ("m", "none"), ("n", "small")}
    assert abs(rows["m", "big"].share_of_size - 0.3) < 0.01 and abs(rows["m", "small"].share_of_size - 0.5) < 0.01
    assert not rows["m", "none"].met and rows["m", "none"].drawn_tokens == 0
    assert rows["n", "small"].actual_share == 1.0 and rows["n", "small"].copies == 2000
    drawn = plan.sample().cache()
    assert drawn.count() == sum(r.copies for r in rows.values()) == drawn.distinct().count()
    assert drawn.filter("mix = 'm'").groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert drawn.exceptAll(mixing.Plan(sizes, targets).sample()).count() == 0
    assert mixing.Plan(sizes.limit(0), targets).sample().count() == 0
