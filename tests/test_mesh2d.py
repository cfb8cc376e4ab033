import numpy as np

from riverframe.operators import mesh2d


def grid(nx, ny, d=1.0):
    out = []
    for i in range(nx):
        for j in range(ny):
            a, b, c, e = (i * d, j * d), ((i + 1) * d, j * d), ((i + 1) * d, (j + 1) * d), (i * d, (j + 1) * d)
            out += [(a, b, c), (a, c, e)]
    return np.array(out, float)


def test_edges():
    left, right, normal, length = mesh2d.edges_of(grid(2, 1))
    assert len(left) == 9 and (right >= 0).sum() == 3 and np.allclose(np.hypot(*normal.T), 1)
    assert abs(length.sum() - (7 + 2 * np.sqrt(2))) < 1e-9


def test_still_water_and_mass():
    xy = grid(6, 4)
    z = np.random.default_rng(1).uniform(0, 0.8, len(xy))
    for _, h, qx, qy in mesh2d.run(xy, z, 1.0 - z, 5.0):
        assert np.allclose(h + z, 1.0, atol=1e-9) and np.allclose(qx, 0, atol=1e-9) and np.allclose(qy, 0, atol=1e-9)
    h0 = np.where(xy.mean(axis=1)[:, 0] < 3, 1.0, 0.0)
    last = list(mesh2d.run(xy, np.zeros(len(xy)), h0, 3.0))[-1]
    assert abs(last[1].sum() - h0.sum()) < 1e-9 and last[1].min() > 0


def test_scenarios(spark):
    xy = grid(4, 2)
    rows = [(s, i, *map(float, t.ravel()), 0.0, s if t[:, 0].mean() < 2 else 0.0) for s in (1.0, 2.0) for i, t in enumerate(xy)]
    mesh = spark.createDataFrame(rows, "scenario double, tri int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, z double, h double")
    out = mesh2d.simulate(mesh, "scenario", 1.0, frames=2).toPandas()
    assert sorted(out.t.unique()) == [0.0, 0.5, 1.0] and len(out) == 2 * 3 * 16
    assert out.groupby(["scenario", "t"]).h.sum().round(9).tolist() == [8.0] * 3 + [16.0] * 3
