from folioflow.llm.queries import RULES
from folioflow.llm.url_filter import rule_table, url_filter

URLS = [
    ("http://a.Example.COM/en/5", "a.example.com", "/en/5", "com/en/", "block"),
    ("http://example.com/en/70?x", "example.com", "/en/70", "example.com/en/7", "allow"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("https://x.example.net/de/8#a", "x.example.net", "/de/8", "example.net/de/8", "block"),
    ("https://net/de/", "net", "/de/", "net/de/", "allow"),
    ("https://org", "org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("x://É.com/en/", "É.com", "/en/", "com/en/", "block"),
    ("http://" + "a." * 3000 + "com/en/" + "x" * 5000, "a." * 3000 + "com", "/en/" + "x" * 5000, "com/en/", "block"),
    ("http://h.com\n/en/", "h.com\n", "/en/", None, "allow"),
]


def test_verdicts_with_clashing_columns_and_repeats(spark):
    rows = [(i, u[0], "old") for i, u in enumerate(URLS)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter(d, rule_table(spark, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:]


def test_precedence_and_empty(spark):
    rules = rule_table(
        spark, [("b.c", "/x", "block"), ("c", "/xyz", "allow"), ("c", "/q", "allow"), ("c", "/q", "block"), (None, "/", "block")]
    )
    d = spark.createDataFrame([(1, "h://b.c/xyz"), (2, "h://c/q")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter(d, rules).collect()} == {1: "b.c/x", 2: "c/q"}
    assert url_filter(d, rules).where("page_id = 2").first().verdict == "block"
    assert url_filter(d.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter(d, rules.limit(0)).collect()} == {"allow"}
