import numpy as np

from tesselon.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, part string"


def brute(rows, cosine=0.98):
    n = {}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.linalg.norm(v):
            return None
        return np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))

    units = [unit(v) if label is not None else None for _, v, label in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = units[i], units[j]
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                n[i] = n.get(i, 0) + 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], n.get(i, 0), least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, label, "p") for i, v, label in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(40):
            base = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((k, (base + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, [0.0] * 16, 0), (k + 1, None, 0), (k + 2, [], 1), (k + 3, [float("nan")] * 16, 1), (k + 4, [float("inf")] + [0.0] * 15, 1), (k + 5, rows[0][1], None), (k + 6, [None] + [1.0] * 15, 0), (k + 7, rows[0][1], 0), (k + 8, [1.0, 2.0], 0)]
    assert got(frame(spark, rows)) == brute(rows)


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.08).astype(np.float32).tolist(), 1) for i in range(120)]
    want, have = brute(rows), got(frame(spark, rows))
    assert [r[2:] for r in have] == [r[2:] for r in want]
    assert sum(r[1] for r in have) >= 0.99 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(have, want, strict=True))


def test_repeated_ids_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    assert got(frame(spark, rows)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert got(frame(spark, rows).limit(0)) == []


def test_plan_reaches_recall():
    for n in (100, 10**5, 10**9):
        k, tables = E.plan(n, 0.98)
        assert 1 - (1 - E.collision(0.2) ** k) ** tables >= 0.99


def test_exact_mode_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 20)
    monkeypatch.setattr(E, "MISS", 0.9)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 16))
    rows = [(i, (base[i % 3] + rng.standard_normal(16) * 0.1).astype(np.float32).tolist(), i % 2) for i in range(150)] + [(200, [1.0, 2.0], 0), (201, [1.0, 2.1], 0)]
    have = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(frame(spark, rows), exact=True).collect())
    assert have == brute(rows)
