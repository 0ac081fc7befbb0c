import math
import random

import pytest

from cinelake.llm import exact_topk


def brute(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        a = min(v for i, v in fine if i == q)
        scores = sorted((-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63)), i) for i, b in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("options", [{}, {"block_rows": 1, "chunk_rows": 7}])
def test_ties_nulls_and_repeats(shipped, options):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) / 2 for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [float("inf")] * 4), (None, [1.0] * 4), (250, [0.0] * 4), (3, rows[3][1]), (50, rows[50][1]), (204, []), (205, [1.0, 1.0]), (206, [1.0] * 6)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS query_id")
    assert got(exact_topk.search(df, **options)) == brute(rows)


def test_large_weights(shipped):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 1e9]), (2, [3e15, 1.0]), (3, [-1e300, 1e300]), (50, [1.5, -2.25])]
    assert got(exact_topk.search(shipped.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_empty(shipped):
    assert exact_topk.search(shipped.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = shipped.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert exact_topk.search(one).count() == 0
