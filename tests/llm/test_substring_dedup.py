import random
from collections import defaultdict
from itertools import combinations

from folioflow.llm import substring_dedup as S
from folioflow.llm.queries import op2_substring_dedup
from folioflow.llm.shingles import MARK_BASE, MARK_BYTES, MARK_PRIME

DATA = "/root/testdata/sf0.01"


def para(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def tokens(text):
    return [
        w for w in (text or "").translate({c: " " for c in range(9, 14)}).translate(
            str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        ).split(" ") if w
    ]


def plain_units(text):
    """(start, words) of each unit, word by word."""
    w = tokens(text)
    mark = [sum(b * pow(MARK_BASE, i, MARK_PRIME) for i, b in enumerate(x.encode()[:MARK_BYTES])) % MARK_PRIME for x in w] + [0, 0]
    three = [sum(f * m for f, m in zip(S.MARK_FACTORS, mark[i : i + 3])) % MARK_PRIME for i in range(len(w))]
    r = S.REACH
    cuts = [i for i in range(r, len(w) - r) if three[i] < min(three[i - r : i]) and three[i] <= min(three[i + 1 : i + r + 1])]
    at = [0, *cuts, len(w)] if w else []
    return [(a, w[a:b]) for a, b in zip(at, at[1:])]


def brute(rows, least=S.LEAST_WORDS):
    """Every pair of different sets that share a shingle compared."""
    places, sets = [], []
    for i, text in rows:
        for k, (start, w) in enumerate(plain_units(text)):
            places.append((i, k, start, len(w)))
            sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)]))
    number = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    up, of = list(range(len(number))), defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, k in number.items():
        for x in s:
            of[x].append((k, s))
    for lists in of.values():
        for (a, s), (b, t) in combinations(lists, 2):
            if 100 * (n := len(s & t)) >= 80 * (len(s) + len(t) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    groups = defaultdict(list)
    for p, s in zip(places, sets):
        groups[root(number[s])].append(p)
    repeated = {p[:2]: (p, min(g)) for g in groups.values() if len({p[0] for p in g}) > 1 for p in g}
    out, run = set(), []
    for key in [*sorted(repeated), None]:
        if run and (key is None or key != (run[-1][0][0], run[-1][0][1] + 1)):
            n = sum(p[3] for p, _ in run)
            if n >= least:
                out.add((run[0][0][0], run[0][0][2], n, sum(p[3] for p, f in run if p != f), min(f[0] for _, f in run)))
            run = []
        if key is not None:
            run.append(repeated[key])
    return out


def mixed(rnd):
    """Passages of all lengths, whole and edited, inside lines and across them."""
    stock = [para(rnd, n) for n in (3, 5, 9, 20, 30, 51, 51, 60, 80, 120)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(3):
            w = rnd.choice(stock).split()
            if rnd.random() < 0.3:
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(5)}"
            parts += [para(rnd, rnd.randrange(1, 40)), rnd.choice((" ", "\n", "\t")).join(w).upper() if rnd.random() < 0.3 else " ".join(w)]
        rows.append((i, rnd.choice((" ", "\n")).join(parts)))
    return [
        *rows, (200, "one two three"), (201, "ONE\ntwo three"), (202, "x " * 3000), (203, "x " * 200 + para(rnd, 30)),
        (205, f"{(alone := para(rnd, 60))} {alone}"), (204, rows[5][1])
    ]


def test_against_every_pair(spark):
    rows = mixed(random.Random(5))
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, unit int, node string").repartition(3)
    for least in (1, S.LEAST_WORDS):
        got = [tuple(r) for r in S.repeated_passages(d, least_words=least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_long_lists_are_compared_by_parts(spark, monkeypatch):
    """Many variants of one passage: lists beyond PART go to finer lists, and those to pairs of parts."""
    rnd = random.Random(8)
    w, rows = para(rnd, 60).split(), []
    for i in range(70):
        x = list(w)
        x[rnd.randrange(60)] = f"edit{rnd.randrange(40)}"
        rows.append((i, " ".join([para(rnd, 20), *x, para(rnd, 20)])))
    monkeypatch.setattr(S, "PART", 4)
    got = {tuple(r) for r in S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least_words=1).collect()}
    assert got == brute(rows, 1)


def test_passages_of_over_50_words_are_caught(spark):
    """Of the documents of the 0.01 table that hold 51 words that another document holds: those given."""
    rows = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = defaultdict(set)
    for i, w in rows.items():
        for k in range(len(w) - 50):
            held[hash(tuple(w[k : k + 51]))].add(i)
    want = set().union(*(x for x in held.values() if len(x) > 1))
    got = {r.doc_id for r in op2_substring_dedup(spark, DATA).collect()}
    assert len(want) > 150 and len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * (len(rows) - len(want))


def test_removal(spark):
    rnd = random.Random(2)
    shared = para(rnd, 70)
    rows = [
        (1, f"{para(rnd, 30)}\n{shared} {para(rnd, 30)}"), (2, f"  {para(rnd, 40)} {shared}\n\n{para(rnd, 5)}"), (2, "another text"),
        (3, None), (4, ""), (None, shared), (5, " \n"), (6, "y" * 100_000)
    ]
    d = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, _gone int, version string").repartition(3)
    out = S.substring_dedup(d)
    assert out.columns == d.columns
    got = {(r.doc_id, r["_gone"], r.version): r.text for r in out.collect() if r.doc_id != 2}
    assert len(out.collect()) == len(rows) and got[(3, 7, "k")] is None and got[(4, 7, "k")] == "" and got[(None, 7, "k")] == shared and got[(5, 7, "k")] == " \n"
    assert got[(1, 7, "k")] != rows[0][1] and "another text" in {r.text for r in out.collect()}
    for least in (1, 25):
        new = {(r.doc_id, r.text) for r in S.substring_dedup(d, least_words=least).collect() if r.doc_id in (1, 2)}
        for i in (1, 2):
            old, gone = next(t for k, t in rows if k == i), set()
            for r in S.repeated_passages(d, least_words=least).collect():
                if r.doc_id == i:
                    assert r.n_words >= least and 0 < r.n_removed <= r.n_words and (i == 2 or r.first_id in (None, 1))
                    if r.n_removed == r.n_words:
                        gone |= set(range(r.start_word, r.start_word + r.n_words))
                    else:
                        gone = None
                        break
            if gone:
                left = " ".join(w for k, w in enumerate(tokens(old)) if k not in gone)
                assert left in {" ".join(tokens(t)) for k, t in new if k == i}
    assert S.repeated_passages(d.limit(0)).count() == 0 and S.substring_dedup(d.limit(0)).count() == 0
