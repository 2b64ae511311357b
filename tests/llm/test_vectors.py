"""Near vectors against brute force, with deep grids, small blocks and hot groups."""
import numpy as np
import pytest

from lograil.llm.vectors import Search, _forest, collisions, near_vectors


def data(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(60):
            center = rng.standard_normal(16)
            for _ in range(rng.integers(1, 4)):
                rows.append((center + 0.08 * rng.standard_normal(16), label))
    hot = rng.standard_normal(16)
    rows += [(hot + 0.05 * rng.standard_normal(16), 1) for _ in range(90)] + [(hot, 1)] * 40
    out = [(i, [float(x) for x in v.astype(np.float32)], label) for i, (v, label) in enumerate(rows)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0] * 8]
    n = len(out)
    out += [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 10, out[0][1], None), (n + 11, [1.0] * 8, 0), (None, out[0][1], out[0][2])]
    return out


def brute(rows, least=0.93):
    usable = [i for i, (_, v, label) in enumerate(rows)
              if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(root(i), []).append(rows[i][0])
    names = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted([(rows[i][0], links[i], names[root(i)]) for i in range(len(rows))], key=str)


@pytest.mark.parametrize("search", [Search(), Search(cell=24, block=20)])
def test_recall_against_brute_force(spark, search):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    found = near_vectors(df, search).collect()
    wanted = brute(rows)
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str)
    assert len(got) == len(rows)
    if search.cell == 512:
        assert got == wanted
    total = sum(x[1] for x in wanted)
    assert 0.97 * total <= sum(x[1] for x in got) <= total
    assert all(a[1] <= b[1] for a, b in zip(got, wanted))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)


def test_grid_and_count_keep_recall():
    s = Search()
    assert s.grid(100) == (0, 1) and s.grid(10**9)[0] > s.grid(10**6)[0] > 0
    rng, hits, trials = np.random.default_rng(0), 0, 3000
    directions = s.directions(64, s.projections, 3)
    for _ in range(trials):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b = s.least * a + np.sqrt(1 - s.least ** 2) * b / np.linalg.norm(b)
        hits += int((np.abs((a - b) @ directions) <= s.window).sum() >= s.count())
    assert hits / trials > 0.95


def test_collisions_and_forest():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((30, 5)), rng.standard_normal((20, 5))
    assert np.array_equal(collisions(a, b, 0.4), (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2))
    assert _forest(6, np.array([4, 2, 1]), np.array([2, 1, 5])).tolist() == [0, 1, 1, 3, 1, 1]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
