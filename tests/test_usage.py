from decimal import Decimal

from folioflow.operators import usage as U

CALLS = "job string, model string, ts timestamp, input_tokens long, cached_tokens long, output_tokens long"
PRICES = "model string, since timestamp, input double, cached double, output double"


def frames(spark, calls, plan, prices=None):
    calls = [(j, m, f"2024-0{month}-01 00:00:00", i, c, o) for j, m, month, i, c, o in calls]
    prices = prices or [("vision", "2024-01-01 00:00:00", 2.0, 0.1, 10.0), ("vision", "2024-06-01 00:00:00", 4.0, 0.2, 20.0), ("other", "2024-03-01 00:00:00", 1.0, 1.0, 1.0)]
    read = lambda rows, schema: spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr(
        *(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", "))
    )
    return read(calls, CALLS), read(prices, PRICES), spark.createDataFrame(plan, "job string, model string, attempts int")


def report(spark, *x, **y):
    return {r.job: r for r in U.usage_report(*frames(spark, *x, **y), "job").collect()}


def test_costs_and_their_gaps(spark):
    calls = [
        ("one", "vision", 2, 1000, 200, 100), ("two", "vision", 2, 1000, 100, 100), ("two", "vision", 2, 1000, 100, 100), ("later", "vision", 6, 1000, 200, 100),
        ("early", "other", 2, 1, 0, 1), ("missing", "vision", 2, 5, 0, 5), ("missing", "vision", 2, None, None, None), ("mismatch", "vision", 2, 1, 0, 1),
        ("mismatch", "other", 5, 1, 0, 1), ("unnamed", "", 2, 1, 0, 1), ("null", None, 2, 1, 0, 1), ("short", "vision", 2, 1, 0, 1), ("odd", "vision", 2, 1, 5, 1), ("stray", "vision", 2, 1, 0, 1)
    ]
    plan = [(j, "vision", n) for j, n in (("one", 1), ("two", 2), ("later", None), ("missing", 2), ("mismatch", 2), ("unnamed", 1), ("null", 1), ("short", 3), ("none", 2), ("odd", 1))]
    got = report(spark, calls, [*plan, ("early", "other", 1)])
    # 800 fresh at 2, 200 cached at 0.1 and 100 out at 10 a million
    assert got["one"].cost == Decimal("0.00262") and got["two"].cost == Decimal("0.00562") and got["later"].cost == 2 * Decimal("0.00262")
    assert (got["two"].calls, got["two"].input_tokens, got["two"].cached_tokens, got["two"].output_tokens, got["two"].models) == (2, 2000, 200, 200, ["vision"])
    assert {j: r.status for j, r in got.items()} == {
        "one": "complete", "two": "complete", "later": "complete", "early": "price_unknown", "missing": "usage_missing", "mismatch": "model_mismatch",
        "unnamed": "model_unreported", "null": "model_unreported", "short": "attempts_unobserved", "none": "no_calls", "odd": "price_unknown"
    }
    assert all(r.cost is None for r in got.values() if r.status != "complete")
    assert (got["short"].unobserved, got["missing"].missing, got["mismatch"].models, got["none"].models, got["none"].input_tokens) == (2, 1, ["other", "vision"], [], None)


def test_a_call_meets_one_price(spark):
    calls, prices, plan = frames(spark, [("a", "vision", 6, 10, None, 0)] * 3, [("a", "vision", 3)])
    twice = prices.union(prices)  # the same prices said again
    assert U.call_costs(calls, twice).count() == 3
    assert U.usage_report(calls, twice, plan, "job").first().cost == Decimal("0.00012")
    assert U.usage_report(calls.limit(0), prices, plan, "job").first().status == "no_calls"
    assert U.usage_report(calls, prices.limit(0), plan, "job").first().status == "price_unknown"
