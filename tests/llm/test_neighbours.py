import numpy as np
from pyspark.sql import functions as F

from granary.llm import neighbours

KIND = "vec_id long, embedding array<float>, label int"


def exact(rows, k):
    """query -> [(vec_id, score)] by brute force in double precision."""
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in [i for i in good if i % 20 == 0]:
        scored = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)], 0) for i in range(1500)]
    same = [float(x) for x in rng.normal(size=8)]
    rows += [(2000 + i, same, 1) for i in range(300)]  # one very common vector
    rows += [(3000, None, 0), (3020, [0.0] * 8, 0), (3040, [float("nan")] + [1.0] * 7, 0), (3060, [None] + [1.0] * 7, 0), (3080, [float("inf")] + [1.0] * 7, 0), (3100, [1.0] * 5, 0), (None, [1.0] * 8, 0), (3120, [], 0)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, KIND).repartition(5), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in found}
    twin = got[2000]
    assert [i for i, s in twin if s == twin[0][1]] == sorted(i for i, s in twin if s == twin[0][1])


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (20, [0.0, 1.0], 0), (20, [0.0, 1.0], 0)], KIND)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got if r["query_id"] == 0][:1] == [(0, 1)] and all(r["vec_id"] != r["query_id"] for r in got)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, [1.0, 2.0]), (120, [1.0] * 4), (140, []), (160, None)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40} and {r["vec_id"] for r in got} <= set(range(60))
    assert all(sum(r["query_id"] == q for r in got) == 20 for q in (0, 20, 40))
