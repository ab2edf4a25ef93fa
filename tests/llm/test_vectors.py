import random

from tidemark.llm.hamming import top_k


def test_top_k_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 1.0]) * rng.random() for _ in range(24)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # one very common vector
    rows += [(2000, None), (2050, None), (None, rows[1][1]), (2001, [float("nan")] * 24), (2002, rows[5][1][:10]), rows[7]]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for r in top_k(df, "id % 50 = 0", 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbor_id, r.distance))
    codes = {i: tuple((v > 0) if k < len(x) else False for k, v in enumerate([*x, *[0] * (24 - len(x))])) for i, x in rows if i is not None and x is not None}
    asked = [i for i in codes if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items())[:7]
        assert sorted(got[q]) == [(k + 1, i, d) for k, (d, i) in enumerate(near)]


def test_few_and_no_rows(spark):
    kind = "id long, vector array<float>"
    assert top_k(spark.createDataFrame([], kind), "id % 50 = 0").count() == 0
    got = top_k(spark.createDataFrame([(0, [1.0, -1.0]), (3, [1.0, 1.0])], kind), "id % 50 = 0", 10).collect()
    assert sorted((r["rank"], r.neighbor_id, r.distance) for r in got) == [(1, 0, 0), (2, 3, 1)]
