import random

import numpy as np

from folioflow.llm import decontaminate as D


def plain_align(a, b):
    h, best, end = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0, 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        assert D.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_align(a, b)


def test_planted_copies(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(12, 60)))) for k in range(30)] + [
        (90, None), (91, ""), (92, "two words"), (93, items_same := "alpha beta gamma delta epsilon zeta eta theta"), (94, items_same)
    ]
    docs, want = [], set()
    for i in range(300):
        w = [rnd.choice(words) for _ in range(rnd.randint(50, 400))]
        if i % 3 == 0:
            k = rnd.randrange(30)
            copy = items[k][1].split()
            if i % 2:  # edited: a word in eight replaced, one lost
                for j in range(3, len(copy), 8):
                    copy[j] = "edited"
                copy.pop(len(copy) // 2)
            at = rnd.randrange(len(w))
            w[at:at] = [x.upper() + ("," if j % 5 == 0 else "") for j, x in enumerate(copy)]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, items_same), (503, "word " * 40000 + items_same), (502, items_same), (None, items_same)]
    want |= {(i, k) for i in (502, 503, None) for k in (93, 94)}
    d = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], "doc_id long, text string, item int, score double").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 2000):  # one pass, and several
        monkeypatch.setattr(D, "PASS_BYTES", size)
        got = D.contaminated(d, b).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 and r.n_words > 0 for r in got)
    clean = {r.doc_id for r in D.clean(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0
    assert D.contaminated(d, b).count() == 1


def test_against_every_pair(spark):
    """Each item aligned with each whole text. A phrase that all items share makes no passages by itself."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    phrase = "which of the following is the best answer to the question".split()
    items = [(k, [*phrase, *(rnd.choice(words) for _ in range(rnd.randint(14, 40)))]) for k in range(12)]
    docs = []
    for i in range(60):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if i % 2:
            w[5:5] = phrase
        if i % 3 == 0:
            copy = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, len(copy) // 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            w[9:9] = copy
        docs.append((i, w))
    number = {w: k for k, w in enumerate([*words, *phrase])}
    as_array = lambda w: np.array([number[x] for x in w], np.uint64)
    want = {(i, k): best / len(a) for i, w in docs for k, a in items if (best := D.align(as_array(a), as_array(w))[0]) >= D.SCORE * len(a)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(d, b).collect()}
    assert len(want) >= 20 and got == want
    made = D.Items([" ".join(w).encode() for _, w in items], D.GRAM)
    shared = D.Items([" ".join(phrase).encode()], D.GRAM)
    count = np.where(np.isin(made.grams, shared.grams), 42, 1)
    assert not np.isin(D.Seeds(made, count, 60).grams, shared.grams).any()


def test_clean_goes_by_id_and_text(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (1, "something else", "b"), (None, text, "c"), (None, None, "d"), (2, "", "e")]
    d = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, mark string, _id int")
    kept = D.clean(d, spark.createDataFrame([(7, text)], "item_id long, text string"))
    assert kept.columns == d.columns and sorted(r.mark for r in kept.collect()) == ["b", "d", "e"]
