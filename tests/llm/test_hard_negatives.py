import math
import random

import pytest
from pyspark.sql import functions as F

from lendspark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, uid string"


def brute(rows, positives=5, negatives=3):
    """All pairs of anchors and rows; rows of one id in any order."""
    use = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, lab) in enumerate(use):
        if i % 50:
            continue
        s = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), j, other) for m, (j, w, other) in enumerate(use) if m != n]
        for p, j, _ in sorted(x for x in s if x[2] == lab)[:positives]:
            window = sorted((q, k) for q, k, other in s if other != lab and 50 * -p <= 100 * -q <= 95 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -q) for rank, (q, k) in enumerate(window, 1)]
    return sorted(out)


def vectors(seed, n, dim=6, scale=1.0):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0.3, 1) * scale, 2) for _ in range(dim)], r.randrange(4)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA).repartition(5)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0, **options).collect())


def exact(rows):
    """As Spark stores them: single precision."""
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_all_pairs(spark, block_bytes):
    rows = vectors(1, 420)
    want = brute(exact(rows))
    assert len(want) > 60
    assert mined(spark, rows, block_bytes=block_bytes) == want


def test_odd_rows(spark):
    rows = vectors(2, 300) + [(None, [1.0] * 6, 1), (1000, None, 1), (1050, [1.0, None] + [1.0] * 4, 1), (1100, [float("nan")] * 6, 1),
                              (1150, [float("inf")] * 6, 1), (1200, [1.0] * 6, None), (1250, [], 2), (1300, [1.0, 2.0], 2), (1301, [1.0] * 9, 2),
                              (1302, [1.0] * 9, 0), (-50, [1.0] * 6, 1), (-49, [0.5] * 6, 0), (1400, [1e30] * 6, 3), (1401, [1e-3] * 6, 1),
                              (1402, [3e12, 1.0, -3e12, 0.0, 2.0, 1.0], 2), (1450, [2e12, -1.0, -1e12, 0.0, 2.0, 1.0], 2)]
    want = brute(exact(rows))
    assert {r[0] for r in want} >= {-50, 1300}
    assert mined(spark, rows) == want


def test_ties_zero_windows_and_repeated_rows(spark):
    """Many equal vectors: ties go to the smaller id, a positive that scores zero opens the window of zero alone."""
    rows = [(i, [1.0, 0.5], i % 3) for i in range(120)] + [(200 + i, [0.8, 0.4], i % 2) for i in range(60)]
    rows += [(i, [0.0, 0.0], 5 + i % 2) for i in range(300, 340)] + [(7, [1.0, 0.5], 1)] * 3 + [(400, [-1.0, -1.0], 1), (401, [1.0, 0.0], 1)]
    want = brute(exact(rows))
    assert {r[4] for r in want} >= {0}
    assert mined(spark, rows) == want


def test_no_rows(spark):
    rows = vectors(3, 60)
    assert mined(spark, []) == [] and mined(spark, [r for r in rows if r[0] % 50]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.schema.simpleString() == ("struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,"
                                         "positive_score:bigint,negative_score:bigint>")
