"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast; a longer list is joined by a shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of a digest that the equi-join compares.
PREFIX_DIGITS = 8
RULES = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())]
)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, 'allow' or 'block')."""
    return spark.createDataFrame(rules, RULES)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest rule
    wins; of equally long ones the one with the longer host; of equal rules, block. A url without a fitting
    rule, null, or without `://` gets `default` and a null rule. Rules with a null part are left out.

    Each distinct (host, path) is expanded into its host suffixes and path prefixes, of those label counts and
    lengths that rules have; expressions meet rules by the first digits of a SHA-256 and then by all of it.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # 'block' > 'allow'
    rules = rules.withColumns({"rule": F.concat("rule_host", "rule_path")})
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(
            F.collect_set(F.size(F.split("rule_host", r"\.")))
        ).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")
    ).first()  # as many numbers as rules have different label counts and path lengths
    digest = lambda c: F.sha2(c, 256)
    rules = rules.withColumn("rule_digest", digest(F.concat_ws("\0", "rule_host", "rule_path")))
    rules = rules.withColumn("short", F.left("rule_digest", F.lit(PREFIX_DIGITS)))
    if shape.n <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels, lengths = (F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>") for xs in (shape.labels, shape.lengths))

    seen = pages.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    hosts = F.transform(
        F.filter(labels, lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")
    )
    paths = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    tried = seen.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(paths).alias("p"))
    tried = tried.withColumn("digest", digest(F.concat_ws("\0", "h", "p"))).withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))
    met = tried.join(rules, "short").where("digest = rule_digest")
    order = F.struct(F.length("rule"), F.length("rule_host"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(order.alias("o"), "rule", "rule_verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
