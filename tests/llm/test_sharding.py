import zlib
from collections import Counter, defaultdict

from folioflow.llm.sharding import shard_documents


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    n = [len(slots[s]) for s in range(shards)]
    assert max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_groups_stay_together(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, f"copy {i // 4}") for i in range(120)]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(4)
    got = shard_documents(d, 8).collect()
    check(rows, got, 8)
    at = defaultdict(set)
    for r in got:
        if r.doc_id >= 1000:
            at[(r.doc_id - 1000) // 4].add(r.shard)
    assert sum(len(x) == 1 for x in at.values()) >= 0.9 * len(at)


def test_hot_group_and_odd_rows(spark):
    rows = [(i, "same") for i in range(200)] + [(300 + i, f"x{i}") for i in range(100)] + [(None, None), (None, None), (7, ""), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, shard_documents(d, 24).collect(), 24)
    few = rows[:3]
    check(few, shard_documents(spark.createDataFrame(few, "doc_id long, text string"), 24).collect(), 24)
    assert shard_documents(d.limit(0)).count() == 0


def test_cut_edges_of_the_tables(spark):
    """Pairs of equal texts that stand apart: far fewer than where shards are dealt by a hash, which cuts 23 in 24."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = defaultdict(list)
    for r in shard_documents(docs).collect():
        if texts[r.doc_id] is not None:
            groups[texts[r.doc_id]].append(r.shard)
    pairs = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    whole = sum(n * (n - 1) // 2 for g in groups.values() for n in Counter(g).values())
    assert pairs >= 50 and pairs - whole <= 0.1 * pairs
