"""Vector search for a table of queries against brute force."""

import random

import pytest

from conftest import rows
from rotorwatch.operators import vector_search


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
    rng = random.Random(2)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    data = [(i, vector()) for i in range(400)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [1.0]), (503, [0.0] * 4), (None, [1.0] * 4)]
    asked = [(f"q{i}", vector()) for i in range(12)] + [("zero", [0.0] * 4), (None, [1.0] * 4), ("none", None)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = vector_search.vector_top_k(frame, spark.createDataFrame(asked, "query string, vector array<double>"), 6)

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 9) if size else None

    want = []
    for name, q in asked[:13]:
        scored = [(-s, i) for i, v in data if v is not None and None not in v and len(v) == 4 and i is not None and (s := cosine(v, q)) is not None]
        want += [(name, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:6])]
    assert rows(got.selectExpr("query", "vec_id", "round(similarity, 8)", "rank")) == sorted([(q, i, round(s, 8) + 0.0, n) for q, i, s, n in want], key=repr)
    assert vector_search.vector_top_k(frame, spark.createDataFrame([], "query string, vector array<double>")).isEmpty()
