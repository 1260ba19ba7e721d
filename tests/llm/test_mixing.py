import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from folioflow.llm.mixing import BLOCK, mix_documents, mix_spans, quotas, source_targets

SCHEMA = "doc_id long, text string, source string, size int, target string"


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = sources[min(int(rng.expovariate(0.7)), len(sources) - 1)]
        t = rng.choice([None, "", " \t", "one\x0btwo three"]) if rng.random() < 0.1 else " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 200)))
        out.append((i if rng.random() < 0.95 else None, t, s, 1, "x"))
    return out


def fill(sizes, weights=(5, 2, 1)):
    """Targets by sharing the excess again until none is above, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, shut = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in shut]
        left = total - sum(2 * sizes[s] for s in shut)
        got = {s: Fraction(2 * sizes[s]) for s in shut} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if got[s] > 2 * sizes[s]}
        if not more:
            return got
        shut |= more


def test_targets_taken_and_bounds(spark):
    for seed, sources in ((1, ["b", "a", None, "", "é", "Z"]), (2, ["only"]), (3, [f"s{i}" for i in range(40)])):
        rows = rows_of(seed, 400, sources)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = mix_documents(docs).collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
        sizes = defaultdict(int)
        for _, t, s, *_ in rows:
            sizes[s] += size(t)
        want = fill(sizes)
        by = defaultdict(int)
        spans = mix_spans(docs)
        for r in spans.groupBy("source").sum("n_words").collect():
            by[r.source] = r["sum(n_words)"]
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        for s, t in want.items():
            assert abs(by[s] - t) < BLOCK, (s, by[s], float(t))
        assert Counter((r.source_size, round(r.target, 6)) for r in got) == Counter((sizes[s], round(float(want[s]), 6)) for _, _, s, *_ in rows)
        taken, parts = Counter(), Counter()
        for r in got:
            taken[r.doc_id] += r.taken
        for r in spans.collect():
            assert r.n_words > 0 and r.start_word >= 0
            parts[r.doc_id] += r.n_words
        assert +taken == +parts
        again = mix_documents(docs.repartition(7)).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_shards_are_apportionments(spark):
    """The quotas up to any shard are those of dealing blocks one by one to the highest quotient."""
    rng = random.Random(5)
    sizes = {f"s{i:02}": rng.randint(50, 6000) for i in range(11)}
    targets = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    plan = quotas(targets, block=16, shards=5).collect()
    for j in range(5):
        got = {r.source: r.upto[j] for r in plan}
        heap = [(-r.target, r.source, 0, r.target, r.source_size * 2 // 16) for r in plan]
        heapq.heapify(heap)
        dealt = Counter()
        while sum(dealt.values()) < sum(got.values()):
            _, s, k, t, most = heapq.heappop(heap)
            if k < most:
                dealt[s] += 1
                heapq.heappush(heap, (-t / (2 * k + 3), s, k + 1, t, most))
        assert dealt == Counter(got)


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, None, 0, ""), (1, None, None, 0, ""), (None, "", None, 0, "")], SCHEMA)
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mix_documents(d).collect()] == [(0, 0, 0.0, 0)] * 3
    assert mix_documents(d.limit(0)).count() == 0 and mix_spans(d).count() == 0
    one = mix_documents(spark.createDataFrame([(1, "a " * 100_000, "s", 0, "")], SCHEMA)).first()
    assert (one.size, one.source_size, one.target, one.taken) == (100_000, 100_000, 150_000.0, 150_000)
    assert mix_documents(d.withColumns({"key": d.source, "at": d.source, "pid": d.source, "before": d.source})).count() == 3
