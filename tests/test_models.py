import numpy as np
import pytest

from assay.functions.holt import holt_forecast
from assay.operators import models as m


def test_holt_follows_a_line_and_damps_noise():
    assert np.allclose(holt_forecast([5 + 3 * i for i in range(20)], 3), [65, 68, 71], rtol=1e-4)
    rng = np.random.default_rng(1)
    noisy = 200 + 4 * np.arange(60) + rng.normal(0, 3, 60)
    assert np.allclose(holt_forecast(noisy, 3), 200 + 4 * np.arange(60, 63), atol=6)
    assert np.allclose(holt_forecast([7.0] * 15, 2), [7, 7])


def test_forecast_per_key(frame):
    rows = [(k, f"{2022 + i // 12}-{i % 12 + 1:02d}-03", float(base + step * i))
            for k, base, step, n in (("a", 10, 2, 18), ("b", 500, -5, 24), ("c", 1, 1, 11)) for i in range(n)]
    df = frame("k string, d string, v double", rows).selectExpr("k", "cast(d as timestamp_ntz) d", "v")
    out = m.forecast(df, "d", "v", "k").collect()
    assert {r["key"] for r in out} == {"a", "b"}                      # eleven months are too few
    ahead = {r["key"]: [] for r in out}
    for r in sorted(out, key=lambda r: r["period"]):
        if r["type"] == "forecast":
            ahead[r["key"]].append((r["period"], r["value"]))
    assert [p for p, _ in ahead["a"]] == ["2023-07", "2023-08", "2023-09"]
    assert np.allclose([v for _, v in ahead["a"]], [46, 48, 50], rtol=1e-3)
    assert np.allclose([v for _, v in ahead["b"]], [380, 375, 370], rtol=1e-3)


def test_importance_finds_the_driver(frame):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=300), rng.normal(size=300)
    df = frame("y double, x double, z double",
               [(float(3 * a + rng.normal(0, .1)), float(a), float(b)) for a, b in zip(x, z)])
    rows = m.feature_importance(df, "y", ["x", "z", "y"], trees=10).collect()
    assert rows[0]["feature"] == "x" and rows[0]["importance"] > 0.9 and rows[0]["r_squared"] > 0.9
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert m.feature_importance(df.limit(29), "y", ["x", "z"]).count() == 0


def test_a_forest_reads_rows_in_tasks_of_bounded_size(frame, monkeypatch):
    seen, spread = [], m._spread
    monkeypatch.setattr(m, "_spread", lambda rows, most: seen.append((*spread(rows, most), most)) or seen[-1][:2])
    df = frame("y double, x double, z double", [(float(i % 7), float(i % 7), float(i % 5)) for i in range(4000)]).coalesce(1)
    rows = m.feature_importance(df, "y", ["x", "z"], trees=10, bag=152 * 500).collect()
    assert rows[0]["feature"] == "x" and rows[0]["n_rows"] == 4000
    (held, n, most), = seen
    sizes = [len(p) for p in held.rdd.glom().collect()]
    assert most == 500 and n == sum(sizes) == 4000 and max(sizes) <= 600


def test_rows_of_a_forest_lie_on_all_cores(spark):
    held, n = m._spread(spark.range(3000).coalesce(1), 10_000, 1000)
    sizes = [len(p) for p in held.rdd.glom().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert n == sum(sizes) == 3000 and len(sizes) == min(3, cores) and max(sizes) <= 2 * n / len(sizes)
    assert m._spread(spark.range(3000).coalesce(1), 10_000)[0].rdd.getNumPartitions() == 1


def plain_kmeans(x, centres, rounds=300):
    """Lloyd's rounds over all points, one fit."""
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[at == k].mean(axis=0) if (at == k).any() else centres[k] for k in range(len(centres))])
        if ((moved - centres) ** 2).sum(axis=1).max() <= 1e-8:
            break
        centres = moved
    at = ((x[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1)
    return moved, at, ((x - moved[at]) ** 2).sum()


def plain_silhouette(x, at):
    """Mean over all points from all pairwise squared distances."""
    d, scores = ((x[:, None] - x[None]) ** 2).sum(axis=2), []
    for i in range(len(x)):
        same = at == at[i]
        if same.sum() == 1:
            scores.append(0.0)
            continue
        own = d[i, same].sum() / (same.sum() - 1)
        other = min(d[i, at == k].mean() for k in set(at) - {at[i]})
        scores.append((other - own) / max(own, other))
    return float(np.mean(scores))


@pytest.mark.parametrize("parts", [1, 7])
def test_all_fits_together_equal_one_by_one(frame, parts):
    rng = np.random.default_rng(4)
    data = np.vstack([rng.normal(c, 1.2, (70, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 2], [4, 4, 9])])
    df = frame("id int, a double, b double, c double", [(i, *map(float, r)) for i, r in enumerate(data)])
    found = m.fit_segments(df.repartition(parts), ["a", "b", "c"], "id", starts=3)
    x = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    silhouette = plain_silhouette(x, np.array([r.segment for r in found.assigned.orderBy("id").collect()]))
    assert found.silhouette == pytest.approx(silhouette, rel=1e-9)
    # a fit at rest: every centre is the mean of its rows, every row is at its nearest centre
    moved, at, cost = plain_kmeans(x, found.centres, rounds=1)
    assert ((moved - found.centres) ** 2).sum() <= 1e-3 and cost == pytest.approx(found.cost, rel=1e-3)
    # no worse than the best of plain fits from many beginnings
    assert found.cost <= 1.02 * min(plain_kmeans(x, m.first_centres(x, found.k, s))[2] for s in range(10))


def test_cells_add_up_to_the_sums_of_all_points(frame, monkeypatch):
    """Few points are compared one by one, and ties still go to the first centre."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (6000, 2)), [[0.0, 0.0]] * 700, [[2.0, 2.0]] * 5])
    df = frame("features array<double>", [(r.tolist(),) for r in x]).coalesce(1)
    monkeypatch.setattr(m, "CELL", 32)
    cells = m._cells(df, 2)
    assert cells.agg({"n": "sum"}).first()[0] == len(x) and cells.rdd.getNumPartitions() > 1
    fits = {1: np.array([[-1.0, 0.0], [1.0, 0.0]]), 2: np.array([[2.0, 2.0], [2.0, 2.0], [50.0, 0.0]])}
    sums = m._cluster_sums(cells, fits)
    for f, centres in fits.items():
        apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        at = apart.argmin(axis=1)
        for c in range(len(centres)):
            own = x[at == c]
            expected = [len(own), apart[at == c, c].sum(), (own ** 2).sum(), *own.sum(axis=0)]
            assert np.allclose(sums[f][c], expected, atol=1e-6)
    facts = np.array([np.frombuffer(r["facts"]) for r in cells.collect()])
    assert m.undivided(facts, fits[1])[1].mean() > 0.6
    assert not m.undivided(facts, fits[2])[1].any()     # equal centres: points decide


def test_segments_do_not_depend_on_the_partitioning(frame):
    rng = np.random.default_rng(9)
    df = frame("id int, a double, b double", [(i, *map(float, rng.normal(i % 3, 1, 2))) for i in range(200)])
    one, many = (m.fit_segments(df.repartition(n), ["a", "b"], "id", starts=2) for n in (1, 9))
    assert one.k == many.k and np.allclose(one.centres, many.centres)
    rows = lambda found: {r.id: r.segment for r in found.assigned.collect()}
    assert rows(one) == rows(many)


def test_three_blobs_give_three_segments(frame):
    rng = np.random.default_rng(0)
    rows = [(i, float(cx + rng.normal(0, .3)), float(cy + rng.normal(0, .3)), None)
            for i, (cx, cy) in enumerate([(0, 0), (10, 2), (20, 0)] * 40)]
    df = frame("id int, x double, y double, gap double", rows)
    found = m.fit_segments(df, ["x", "y", "gap"], "id")
    assert found.k == 3 and found.columns == ["x", "y"] and found.silhouette > 0.9
    profile = m.segment_profiles(found).collect()
    assert [r["size"] for r in profile] == [40, 40, 40]
    assert sum(r["pct_of_data"] for r in profile) == pytest.approx(100)
    contrast = m.segment_contrast(found).first()
    assert contrast["best_mean"] >= contrast["worst_mean"]
    assert m.fit_segments(df, ["x"]) is None


def test_planted_outliers_are_found(frame):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    rows += [(1000 + i, 12.0 + i, 0.0) for i in range(5)]
    df = frame("id int, a double, b double", rows)
    scored = m.anomalies(df, ["a", "b"], "id")
    s = m.anomaly_summary(scored).first()
    assert s["n_rows"] == 405 and s["n_anomalies"] == pytest.approx(0.05 * 405, abs=1)
    assert {r["id"] for r in m.top_anomalies(scored, "id", n=5).collect()} == {1000 + i for i in range(5)}
    assert m.standout_columns(scored, ["a", "b"]).first()["column"] == "a"
    low, high = scored.selectExpr("min(anomaly_score)", "max(anomaly_score)").first()
    assert -1 <= low < high <= 0
    assert m.anomalies(df.limit(49), ["a", "b"]) is None


def test_gates(frame):
    from assay.operators.profiling import profile

    def status(n):
        rows = [(float(i), float(i * i % 7), f"2024-01-{i % 28 + 1:02d}") for i in range(n)]
        prof = profile(frame("price double, w double, day string", rows))
        return {r["model"]: r["status"] for r in m.ml_gates(prof).collect()}

    assert status(19) == {"feature_importance": "skipped", "segments": "skipped",
                          "anomalies": "skipped", "forecast": "run"}
    assert status(30) == {"feature_importance": "run", "segments": "run", "anomalies": "skipped",
                          "forecast": "run"}
    assert set(status(50).values()) == {"run"}
