import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import vectors


def reduce(vec, dim):
    if len(vec) <= dim:
        return list(vec)
    head = np.array(vec[:dim], dtype=np.float32)
    total = float((head.astype(np.float64) ** 2).sum())
    return head.tolist() if total == 0 else (head / np.float32(math.sqrt(total))).tolist()


def test_mrl_reduce(evaluate):
    long = [float(i % 17) - 8.5 for i in range(3072)]
    (out,) = evaluate(lambda c: vectors.mrl_reduce(c, 768), [long], "array<float>")
    assert len(out) == 768
    assert abs(math.sqrt(sum(v * v for v in out)) - 1) < 1e-5


def test_mrl_reduce_edges(evaluate):
    rng = random.Random(3)
    inputs = [[rng.uniform(-1, 1) for _ in range(n)] for n in (3, 4, 5, 9)] + [[0.0] * 6, [0.0, 0.0, 0.0, 0.0, 5.0]]
    inputs = [np.array(v, dtype=np.float32).tolist() for v in inputs]
    got = evaluate(lambda c: vectors.mrl_reduce(c, 4), inputs, "array<float>")
    for ours, theirs in zip(got, [reduce(v, 4) for v in inputs]):
        assert ours == pytest.approx(theirs, abs=1e-7)
    assert got[0] == inputs[0]  # short vectors are not normalised


def test_cosine_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    near, none = [r.d for r in rows.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert near == pytest.approx(1 - 1 / math.sqrt(2))
    assert math.isnan(none)
    wrong = spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="different vector dimensions 1 and 2"):
        wrong.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()


def test_expression_and_block_agree(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 8)).astype(np.float32)
    rows = spark.createDataFrame([(r.tolist(),) for r in data], "v array<float>")
    query = F.array(*[F.lit(float(x)) for x in data[0]])
    ours = [r.d for r in rows.select(vectors.cosine_distance(F.col("v"), query).alias("d")).collect()]
    block = vectors.distances(data.astype(np.float64), data[:1].astype(np.float64))[:, 0]
    assert np.allclose(sorted(ours), sorted(block), atol=1e-9)
