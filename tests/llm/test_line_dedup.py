from folioflow.llm.line_dedup import line_dedup


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x, gone = t.split("\n"), set()
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if any(y.strip(" ") for y in w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out[i] = ("\n".join(y for k, y in enumerate(x) if k not in gone), len(x), len(gone))
    return out


def test_against_brute_force(spark):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, "p\np\np\np\np"), (5, ""), (6, "\n\n\n\n"),
        (7, "\n".join(f"l{i}" for i in range(5000))), (8, "\n".join(f"l{i}" for i in range(4000, 4500))), (9, "a\nb\nc")
    ]
    d = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, n_lines int, pos string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(d).collect()}
    assert got == brute(rows)
    assert set(line_dedup(d).columns) == {"doc_id", "text", "pos", "n_lines", "n_removed"}


def test_nulls_repeats_and_empty(spark):
    d = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup(d).collect()), key=str)
    assert got == sorted([(None, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (2, None, 0)], key=str)
    assert line_dedup(d.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    d = spark.createDataFrame(
        [(1, "a\nb\nc", 7, "v", 8, "o"), (2, "a\nb\nc\nd", 9, "w", 1, "p")],
        "key long, text string, id int, version string, _gone int, _of string"
    )
    got = sorted(line_dedup(d, id_col="key").collect())
    assert got[0].asDict() == {"key": 1, "text": "a\nb\nc", "id": 7, "version": "v", "_gone": 8, "_of": "o", "n_lines": 3, "n_removed": 0}
    assert got[1].asDict() == {"key": 2, "text": "d", "id": 9, "version": "w", "_gone": 1, "_of": "p", "n_lines": 4, "n_removed": 3}
    assert set(line_dedup(d.drop("key"), id_col="id").columns) == {"text", "id", "version", "_gone", "_of", "n_lines", "n_removed"}
