import numpy as np

from folioflow.llm import embedding_dedup as E


def brute(rows):
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    good = [
        (
            i, l, np.array(v, float)
        ) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
    ]
    for k, (i, l, v) in enumerate(good):
        for j, m, w in good[:k]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i in up}


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 32))
    rows = [(i, i % 3, (base[i % 60] + rng.normal(scale=0.2 * (i % 4), size=32)).tolist()) for i in range(600)]
    rows += [(1000 + i, 1, rows[1][2]) for i in range(30)] + [
        (2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 32), (2003, 0, [float("nan")] * 32), (2004, 0, [None] * 32),
        (2005, 0, []), (2006, 0, [1.0, 2.0]), (2007, 0, [2.0, 4.0]), (2008, 1, [float("inf")] * 32)
    ]
    d = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<float>, node int").repartition(3)
    rows = [(r.vec_id, r.label, r.embedding) for r in d.collect()]
    for part in (4096, 16):
        monkeypatch.setattr(E, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(d).collect()}
        want = brute(rows)
        assert set(got) == set(want)
        assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        for i in range(2000, 2009):
            assert got[i] == want[i]


def test_no_list_is_left_out(spark, monkeypatch):
    """Pairs just above the threshold, over far more lists than a vector's nearest few: all are found."""
    monkeypatch.setattr(E, "PER_LIST", 4)
    monkeypatch.setattr(E, "SAMPLE", 1200)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pair = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    rows = [(2 * i + k, 7, v.tolist()) for i in range(2000) for k, v in enumerate((x[i], pair[i]))]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    for part in (4096, 700):
        monkeypatch.setattr(E, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(d).collect()}
        assert got == {i: (1, i - i % 2) for i in range(4000)}


def test_probes_at_4096_lists():
    """Recall of the probes for partners at the threshold, and how many lists are probed: at few lists and at many."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=(2000, 64))
    u -= (u * x[:2000]).sum(1, keepdims=True) * x[:2000]
    y = 0.9301 * x[:2000] + np.sqrt(1 - 0.9301**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    for lists, most in ((40, 0.5), (4096, 0.02)):
        index = E.Index(x[:16384], lists)
        (a, of_x), (b, of_y) = index.probes(x[:2000], 0.93), index.probes(y, 0.93)
        row = np.arange(2000)
        met = (a == b) | of_x[row, b] | of_y[row, a]
        assert met.mean() >= 0.999 and of_x.mean() <= most


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
