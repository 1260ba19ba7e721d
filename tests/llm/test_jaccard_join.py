import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import jaccard_join as J


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        both = Counter(y for x in s for y in lists[x])
        for x in s:
            lists[x].append(i)
        for y, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[y]) - n):
                a, b = root(i), root(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    rnd = random.Random(5)
    base, out = [f"w{rnd.randrange(900)}" for _ in range(120)], []
    shared = [f"s{k}" for k in range(40)]
    for _ in range(250):
        w = list(rnd.choice([base, base, out[-1].split() if out else base]))
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w[rnd.choice([0, 0, 7]) :]))
    out += [" ".join([*(f"u{k}-{j}" for j in range(60)), *shared]) for k in range(40)]
    out += ["a b", "A  b", "a b c", "a b c d e", "a b c d E f", "x " * 300, "x " * 400] + out[:3]
    rows = [(i + 1, t) for i, t in enumerate(out)] + [
        (9001, None), (9002, ""), (9003, " \n"), (9004, " ".join(f"v{k}" for k in range(20000))),
        (9005, " ".join(f"v{k}" for k in range(2000, 20000)))
    ]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [384, 40])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(J, "PART", part)
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(d).collect()}
    assert got == brute(rows)


def test_similar_answered_sets_answer(monkeypatch):
    """Of each family of similar sets one counts its overlaps; the others' answers follow from its, however many families."""
    sets = [np.array([*range(100 * f, 100 * f + 40), 100 * f + 50 + k], np.uint64) for f in range(16) for k in range(10)]
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: counted.append(1) or bincount(*a, **b))
    links = J.links_within(sets, 80)
    assert len(counted) == 16
    assert len(links) == 16 * 9 and all(a // 10 == b // 10 for a, b in links)


def test_repeats_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.jaccard_components(d).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (8, 8)], key=str)
    assert J.jaccard_components(d.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in J.keep_first(d).collect()) == [0, 7, 7, 8]


def test_links_within_is_a_forest_of_all_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**62, 60, dtype=np.uint64))
    sets = [
        np.unique(
            np.concatenate(
                [rng.choice(base, rng.integers(35, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 6), dtype=np.uint64)]
            )
        ) for _ in range(60)
    ]
    f = J.Forest(60)
    for a, b in J.links_within(sets, 80):
        assert f.link(a, b)
    g = J.Forest(60)
    for a in range(60):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                g.link(a, b)
    assert [f.root(i) for i in range(60)] == [g.root(i) for i in range(60)]


def test_blocks_that_come_in_several_batches(spark):
    """A block's counts reach it whole, however its texts were dealt to batches."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for i in range(0, 300, 3):
        w = [rnd.choice(words) for _ in range(rnd.randint(30, 90))]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:-1], "edited"])), (i + 2, " ".join(["more", *w, "words"]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(d).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == brute(rows)


def test_keep_first_by_id_and_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long, "a"), (2, long + " more", "b"), (2, "quite another text of its own", "c"), (2, long, "d"), (None, long, "e"),
        (3, None, "f"), (3, "", "g"), (1, long, "h")
    ]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, mark string, version int, _id int").repartition(3)
    got = J.keep_first(d)
    assert got.columns == d.columns and sorted(r.mark for r in got.collect()) == ["a", "c", "e", "f", "g", "h"]
    assert J.keep_first(d.limit(0)).count() == 0
