import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from folioflow.llm.vector_codes import compress, nearest, search_order


def brute(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    width = len(ints[0])
    seeds = sorted({i for i, *_ in kept})[:entries]
    of = {}
    for (i, *_), v in zip(kept, ints):
        of[i] = min(of.get(i, v), v)
    books = [[of[i][width * p // 4 : width * (p + 1) // 4] for i in seeds] for p in range(4)]

    def assign():
        out = []
        for v in ints:
            each = []
            for p, b in enumerate(books):
                x = v[width * p // 4 : width * (p + 1) // 4]
                each.append(min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b)))
            out.append(each)
        return out

    for _ in range(rounds):
        got = assign()
        for p, b in enumerate(books):
            sums = defaultdict(list)
            for v, each in zip(ints, got):
                sums[each[p][1]].append(v[width * p // 4 : width * (p + 1) // 4])
            for k, xs in sums.items():
                b[k] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for (i, _, label), each in zip(kept, assign()):
        by[label] += sum(d for d, _ in each)
        out.append((i, "".join(f"{k:02x}" for _, k in each), sum(d for d, _ in each), label))
    return sorted((i, c, e, by[label], sha) for i, c, e, label in out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, vec int, error string")


@pytest.mark.parametrize("seed,entries,width", [(1, 256, 8), (2, 8, 10), (3, 5, 16)])
def test_against_brute_force(spark, seed, entries, width):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.0, -1.5]) for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(200)]  # a hot vector
    rows += [(5000, None, 1), (5001, [math.nan] * width, 2), (5002, [math.inf] + [0.0] * (width - 1), None), (5003, [None] + [1.0] * (width - 1), 1)]
    rng.shuffle(rows)
    out, books = compress(table(spark, rows).repartition(5), entries=entries)
    assert sorted(map(tuple, out.collect())) == brute(rows, entries)
    assert len(books) == 4 and all(len(b) == min(entries, 500) for b in books)


def test_search_is_exact_and_ties_go_low():
    rng = np.random.default_rng(7)
    for n, k, d in ((400, 256, 16), (50, 1, 3), (200, 40, 1), (300, 200, 4)):
        x, book = rng.integers(-5, 5, (n, d)), rng.integers(-5, 5, (k, d))
        far = ((x[:, None, :] - book[None]) ** 2).sum(2)
        at, best = nearest(x, book, search_order(book))
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0] * 4, 1), (2, [1.0], 1), (3, [], 1)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in compress(table(spark, rows))[0].collect()}
    assert got == {(1, "00000000", 0, 0), (None, "01010101", 0, 0), (2, None, None, 0), (3, None, None, 0)}
    assert compress(table(spark, rows[:0]))[0].count() == 0
    assert compress(table(spark, [(3, [], 1), (4, None, 1)]))[0].first().code == "00000000"
    with pytest.raises(Exception, match="64 bits"):
        compress(table(spark, [(1, [1e30] * 4, 1)]))
