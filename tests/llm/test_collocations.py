import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import collocations as C


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in {x for x, _ in cand}:
        own = {p: a for (x, p), a in cand.items() if x == lang}
        rows = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed, docs=120, words=14):
    rng = random.Random(seed)
    vocabulary = ["The", "cat", "sat", "ÜBER", "é", "日本", "a'b", "x\x01y", "on", "mat", "in", "of", "and", "to"][:words]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["the cat sat on", "of and to", rng.choice(vocabulary), rng.choice(vocabulary)]))
            parts.append(rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", " \xa0 "]))
        out.append((rng.choice(["en", "en", "en", "de", None]), "".join(parts)))
    return out + [("en", None), (None, ""), ("fr", "rare words"), ("en", " \t.,"), ("de", "a a a a a a a a a a a a a a a a a a a a")] + out[:7]


@pytest.mark.parametrize("seed,least,buckets", [(1, 10, 1 << 16), (2, 25, 64), (3, 3, 1 << 20), (4, 300, 1 << 16)])
def test_against_brute_force(spark, seed, least, buckets):
    """64 buckets let everything pass; then only exact counts decide."""
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(3)
    got = C.collocations(docs, least=least, buckets=buckets)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least)
    assert sorted(map(tuple, C.collocations(docs, least=least, buckets=buckets, top=3).collect())) == brute(rows, least, top=3)


def test_stretches_hold_every_phrase_once(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 37)
    texts = [t.encode() for _, t in made(5, 20) if t] + [b"w" * 100 + b" a b c d e f " + b"v" * 90]
    for k in range(1, 6):
        got, want = Counter(), Counter()
        for words, carried in C.stretches(texts):
            at = [i for i in range(len(words) - k + 1) if words.whole(k)[i] and i + k > carried]
            known = words.known.to_pylist()
            got.update(tuple(known[words.ids[i + j]] for j in range(k)) for i in at)
        for t in texts:
            for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t.decode())):
                w = re.findall(r"[^ \t]+", piece)
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        assert got == want


def test_very_long_text_and_empty_tables(spark):
    text = "lorem ipsum dolor " * 400_000
    docs = spark.createDataFrame([("la", text)], "lang string, text string")
    (top, *_) = C.collocations(docs).where("rank = 1").collect()
    assert top.n == 1_200_000 and top.a in (399_999, 400_000)
    assert C.collocations(docs.limit(0)).count() == 0
    assert C.collocations(docs.select("lang", F.lit(None).cast("string").alias("text"))).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(123_456_789_012_345, 99_999_999_999_999, 123_456_789_012_399, 223_456_789_012_345), (100, 100_000_000_000_000, 100, 100), (7, 3, 1000, 21)]
    d = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r.s for r in d.select(C.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]
