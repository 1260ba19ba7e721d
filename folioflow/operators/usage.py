"""Usage and cost of calls: versioned prices, and estimates that are null as soon as something is not known."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A price is for a million tokens: what a token's is of it.
MILLIONTH = Decimal("0.000001")


def price_versions(prices: DataFrame) -> DataFrame:
    """prices (model, since, input, cached, output) with `until`, when the model's next price begins (null: it still holds).

    Of several prices of a model that begin at once the highest counts. Prices without a model or a beginning go.
    """
    one = prices.where("model is not null and since is not null").groupBy("model", "since").agg(F.max(F.struct("input", "cached", "output")).alias("p"))
    return one.select("model", "since", "p.*", F.lead("since").over(W.partitionBy("model").orderBy("since")).alias("until"))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, ts, input_tokens, cached_tokens, output_tokens and others) with `cost`, by the price that held at their time.

    Cached tokens are a part of the input tokens with a price of their own; none reported is none cached. The cost is
    exact decimal arithmetic, and null where a count, the model, the time or a price isn't known, or more is cached
    than came in. Each call meets its model's prices by equality, at most one of which holds; prices are few a model,
    calls of a model may be any many.
    """
    p = price_versions(prices).select(F.col("model").alias("_model"), "since", "until", *(F.col(c).cast("decimal(12,6)").alias(f"_{c}") for c in ("input", "cached", "output")))
    held = (F.col("model") == F.col("_model")) & (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    whole = lambda c: F.col(c).cast("decimal(12,0)")  # noqa: E731  small enough for products to keep all digits
    cached = F.coalesce(whole("cached_tokens"), F.lit(0).cast("decimal(12,0)"))
    fresh = whole("input_tokens") - cached
    cost = (fresh * F.col("_input") + cached * F.col("_cached") + whole("output_tokens") * F.col("_output")) * F.lit(MILLIONTH).cast("decimal(6,6)")
    fine = (cached >= 0) & (fresh >= 0) & (whole("output_tokens") >= 0)
    out = calls.join(p, held, "left").withColumn("cost", F.when(fine, cost).cast("decimal(30,12)"))
    return out.drop("_model", "since", "until", "_input", "_cached", "_output")


def usage_report(calls: DataFrame, prices: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """A row for each group of plan (key, model, attempts): what its calls used, and what that costs.

    models: those that the calls name, sorted. missing: calls without counts of input and output. unobserved: attempts
    that the plan knows of and no call shows. status, the first that holds: no_calls, attempts_unobserved,
    usage_missing, model_unreported (null or empty), model_mismatch (another than the plan's), price_unknown, and else
    complete. cost is null unless complete: one unknown call makes the sum unknown, never smaller. Token sums are of
    what was reported, and null where nothing was. Groups of which only calls are known don't show.
    """
    rows = call_costs(calls, prices).withColumn("_named", F.nullif("model", F.lit("")))
    some = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    per = rows.groupBy(F.col(key).alias("_key"), "_named").agg(  # a few rows a group: one for each model
        F.count(F.lit(1)).alias("n"), F.count_if(~some).alias("m"), F.count_if(F.col("cost").isNull()).alias("u"), F.sum("cost").alias("c"),
        *(F.sum(f"{c}_tokens").alias(c) for c in ("input", "cached", "output"))
    )
    one = per.groupBy("_key").agg(
        F.sum("n").alias("calls"), F.sum("m").alias("missing"), F.sum("u").alias("_unknown"), F.sum("c").alias("_cost"),
        *(F.sum(c).alias(f"{c}_tokens") for c in ("input", "cached", "output")), F.array_sort(F.collect_set("_named")).alias("models"),
        F.bool_or(F.col("_named").isNull()).alias("_unreported")
    )
    out = plan.select(key, F.col("model").alias("_plan"), "attempts").join(one, F.col(key).eqNullSafe(F.col("_key")), "left")
    calls_ = F.coalesce("calls", F.lit(0).cast("long"))
    other = F.exists("models", lambda m: ~m.eqNullSafe(F.col("_plan")))
    status = F.when(calls_ == 0, "no_calls").when(F.col("attempts") > calls_, "attempts_unobserved").when(F.col("missing") > 0, "usage_missing").when(
        F.col("_unreported"), "model_unreported"
    ).when(other, "model_mismatch").when(F.col("_unknown") > 0, "price_unknown").otherwise("complete")
    return out.withColumn("status", status).select(
        key, calls_.alias("calls"), F.greatest(F.coalesce(F.col("attempts").cast("long"), calls_) - calls_, F.lit(0)).alias("unobserved"),
        F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), "input_tokens", "cached_tokens", "output_tokens",
        F.coalesce("models", F.array().cast("array<string>")).alias("models"), "status", F.when(F.col("status") == "complete", F.col("_cost")).alias("cost")
    )
