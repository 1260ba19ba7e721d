import random
import zlib

import numpy as np

from folioflow.llm import quality_fm as Q


def corpus(n=600):
    rnd, out = random.Random(6), []
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(30, 200))]
        good = i % 4 != 0
        out.append((i, " ".join(w).capitalize() + "." if good else "!! ".join(x.upper() for x in w[:20]) * 3, int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(
        [(i, t, len(t), 0.0, "x") for i, t, _ in rows], "doc_id long, text string, n_chars long, score double, lang string"
    ).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = Q.fit_quality(docs, labels)
    got = {r.doc_id: r for r in Q.score_quality(docs, m).select("*", Q.is_held_out().alias("held_out")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held == [i for i in sorted(got) if got[i].held_out] and len(held) > 50
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in Q.score_quality(docs.repartition(5), Q.fit_quality(docs.repartition(2), labels)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_sum_of_squares_identity():
    docs, feats, vals = Q.features([b"one two two THREE", b"", None, b"x\nx\nx"], [5, None, 0, 3])
    m = Q.Machine(1)
    m.v *= 20
    z = m.parts(docs, feats, vals, 4)[0]
    for d in range(4):
        f, x = feats[docs == d], vals[docs == d]
        pairs = sum(x[i] * x[j] * m.v[f[i]] @ m.v[f[j]] for i in range(len(f)) for j in range(i))
        assert abs(z[d] - pairs) < 1e-9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score_quality(docs, Q.fit_quality(docs, none)).collect()
    assert len(got) == 4 and all(0.4 < r.score < 0.6 and r.predicted == 1 for r in got)
    assert Q.score_quality(docs.limit(0), Q.Machine()).count() == 0


def test_columns_of_any_name_and_long_texts(spark):
    rows = [(1, "a b c", "x", "7", 5), (2, "word " * 100_000, "y", "no number", 6), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_chars string, _chars int")
    got = Q.score_quality(docs, Q.Machine()).collect()
    assert sorted(((r.doc_id, r.text, r["_text"], r.n_chars, r["_chars"]) for r in got), key=str) == sorted(rows, key=str)


def test_held_out_rows_of_the_tables(spark):
    """Labels that the fit never saw: accuracy and the share of pairs in order (0.996 and 0.99995 when written)."""
    from folioflow.llm.queries import op9_quality_fm

    data = "/root/testdata/sf0.1"
    got = op9_quality_fm(spark, data).join(
        spark.read.parquet(f"{data}/labels.parquet"), "doc_id"
    ).where("held_out and quality is not null").collect()
    good, bad = (np.array([r.score for r in got if r.quality == y]) for y in (1, 0))
    assert len(good) > 500 and len(bad) > 80
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.98 and (good >= 0.3).mean() >= 0.99
    assert (good[:, None] > bad).mean() >= 0.99
