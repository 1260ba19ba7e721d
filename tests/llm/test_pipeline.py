import corpus_pipeline as P
from pyspark.sql import functions as F
from test_jaccard_join import brute as near
from test_line_dedup import brute as lines

DATA = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(i in texts[1] for i, q in labels.items() if q == 1 and i in texts[0])
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in texts[1] for i in bad) <= 0.05 * len(bad)
    want = {i: t for i, (t, n, gone) in lines(texts[1].items()).items() if not gone or gone < n}
    assert texts[2] == want
    assert set(texts[3]) == {i for i, (_, c) in near(texts[2].items()).items() if i == c}
    assert set(texts[4]) <= set(texts[3]) and {r.doc_id for r in docs.collect()} == set(texts[4])
    assert sorted(P.run(spark, DATA).collect()) == sorted(docs.collect())


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, shared ids, other columns, and an empty table."""
    good = " ".join(f"Word{i} follows the others here." for i in range(80))
    rows = [
        (1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)),
        (1, "Another text, under the same id as others.", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0),
        (3, "\n\n\n", "en", "s", 3)
    ]
    rows += [
        (4, good + " And more.", "en", None, 5), (5, "The capital of France is known to be the city of Paris.", "en", "s", 9),
        (6, "long " * 200_000, "en", "s", 10), (None, "No id.", "en", "s", 6)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({"version": F.lit(1), "_text": F.lit("x"), "_id": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0), (9, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(
        [(1, "The capital of France is known to be the city of Paris"), (2, None), (3, "")], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in P.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept.append(at)
        assert at.limit(0).count() == 0
    assert kept[0].count() == len(rows) and kept[1].count() == len(rows)
    near = sorted(((r.doc_id, (r.text or "")[:7]) for r in kept[2].collect()), key=str)
    assert near == sorted(
        [
            (1, "Word0 f"), (1, "Word0 f"), (1, "Another"), (None, ""), (2, ""), (3, "\n\n\n"), (5, "The cap"), (6, "long lo"),
            (None, "No id.")
        ],
        key=str
    )
    assert {r.doc_id for r in kept[3].collect()} == {1, 2, 3, 6, None} and kept[4].count() == 8
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
