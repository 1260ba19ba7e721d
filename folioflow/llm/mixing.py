"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

A source's documents are laid end to end in a seeded order, again and again, and that line is cut into blocks of
`block` words. A source of target t asks for its block number k (from 0) with the quotient t / (2k + 1), and the highest
quotients get blocks. The house, that is how many blocks are dealt in all, is fixed by the quotient at which dealing
stops: with block / 2, a source gets t / block blocks, rounded, which is Sainte-Laguë's apportionment of their sum. The
shards are bands of the same order: shard j of J ends at the quotient block * J / (2 * j). So the shards up to any j are
themselves an apportionment, a source's quota in a shard is a whole number, and nothing but sources is ever counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, prefix_sums

#: Weights of the sources in their order, again and again; words the mix takes for each word there is; how often a word
#: may be taken; words of a block (a block costs nothing, so they can be small and sources come close to their targets).
WEIGHTS, SHARE, REPEATS, BLOCK, SHARDS, SEED = (5, 2, 1), 1.5, 2, 8, 8, 12
WORD, SPACES = r"[^\x20\x09-\x0D]++", " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """The runs of other characters than 0x20 and 0x09-0x0D; null has none."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with `weight` and `target`.

    Sources by code point, null last, get the weights in turn. Targets are in proportion to the weights and sum to
    `share` times all sizes; where one would pass `repeats` times its source's size it stops there, and the excess is
    shared again by weight until none is above. A round of this is one sum over the sources. Each target is one
    division of whole numbers (share times two must be whole). An empty table gives an empty one.
    """
    assert share <= repeats and 2 * share == int(2 * share), "targets of that share don't fit"
    ranked = prefix_sums(cut(sources.orderBy(F.col("source").asc_nulls_last())), [])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats).drop("rank"))
    whole = ranked.agg(F.sum(_whole(F.col("source_size"))).alias("size"), F.sum("weight").alias("weight")).first()
    twice, left, open_ = int((whole["size"] or 0) * int(2 * share)), int((whole["size"] or 0) * int(2 * share)), int(whole["weight"] or 0)
    above = F.lit(False)
    while open_:  # with all left for the open ones, those that pass their bound are closed; what is left a weight only grows
        above = _whole(F.col("weight")) * F.lit(left).cast("decimal(25,0)") > _whole(F.col("most")) * F.lit(2 * open_).cast("decimal(12,0)")
        shut = ranked.where(above).agg(F.sum(_whole(F.col("most"))).alias("most"), F.sum("weight").alias("weight")).first()
        now = twice - 2 * int(shut["most"] or 0), int(whole["weight"]) - int(shut["weight"] or 0)
        if now == (left, open_):
            break
        left, open_ = now
    shared = F.col("weight") * F.lit(float(left)) / F.lit(2.0 * max(1, open_))
    return ranked.withColumn("target", F.when(above, F.col("most").cast("double")).otherwise(shared)).drop("most")


def quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, repeats: int = REPEATS) -> DataFrame:
    """targets with `quota`, the blocks a source gives, and `upto`, those it has given by the end of each shard.

    A block number k is dealt by the end of shard j where target / (2k + 1) >= block * shards / (2j): the source has
    then given its share j / shards of target / block, rounded. Blocks beyond `repeats` times the source aren't there.
    """
    there = F.floor(F.col("source_size") * repeats / block)
    dealt = [F.least(F.floor(F.col("target") * j / (block * shards) + 0.5), there).cast("long") for j in range(1, shards + 1)]
    return targets.withColumn("quota", dealt[-1]).withColumn("upto", F.array(*dealt))


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, plan) -> DataFrame:
    """(id, source, size, start: words before it in its source's seeded order, and what plan says of its source) of each row.

    Rows are sorted by source and seeded hash over all tasks, so a source of a third of all rows lies in many. What a
    source's earlier rows hold is summed a partition; rows meet it by (partition, source), never by source alone.
    """
    source = F.col(source_col).cast("string")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("a"), source), F.lit("b")).alias("key"), F.substring(order, 1, 16).alias("order"),
        F.col(id_col).alias("id"), n_words(F.col(text_col).cast("string")).alias("size")
    )
    rows = cut(rows)  # texts are read once; a sort looks at its rows twice
    line = cut(rows.orderBy("key", "order", "id", "size"))
    line = line.withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("at", 33))
    held = cut(line.groupBy("pid", "key").agg(F.sum("size").alias("held")))
    until = W.partitionBy("key").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    held = held.withColumn("before", F.coalesce(F.sum("held").over(until), F.lit(0)))
    sources = held.groupBy("key").agg(F.sum("held").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("key") != "b", F.substring("key", 2, 2147483647)))
    told = held.select("pid", "key", "before").join(plan(sources), "key")
    inside = W.partitionBy("pid", "key").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return line.join(told, ["pid", "key"]).withColumn("start", F.col("before") + F.col("inside"))


def _planned(docs, id_col, text_col, source_col, weights, share, repeats, block, shards, seed) -> DataFrame:
    return _laid(
        docs, id_col, text_col, source_col, seed,
        lambda sources: quotas(source_targets(sources, weights, share, repeats), block, shards, repeats)
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: words, words and target of its source, words that the mix takes of it.

    A source's blocks are taken in its seeded order, so most documents are taken whole, once or `repeats` times. The
    words taken of a source are within block / 2 of its target, or less than a block below it where it takes all
    there is. A null text has no words, an empty one neither; null sources are one source, the last; an empty source
    is another. Rows that repeat are rows of their own, and rows alike in id and size may change places, which the
    result doesn't show. A rerun gives the same. An empty table gives an empty one; other columns are left alone.
    """
    laid = _planned(docs, id_col, text_col, source_col, weights, share, repeats, block, shards, seed)
    whole, upto = F.col("source_size"), F.col("quota") * block
    passes = F.when(whole > 0, F.floor(upto / whole)).otherwise(0).cast("long")
    rest = upto - passes * whole
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """(id, source, shard, turn, start_word, n_words): what each shard (from 0) takes of each document.

    turn counts the passes over the source. Of a document, a shard takes one run of words in a turn; documents of
    which nothing is taken have no row. Odd rows are as in mix_documents, whose `taken` is the sum of n_words.
    """
    laid = _planned(docs, id_col, text_col, source_col, weights, share, repeats, block, shards, seed)
    spans = []
    for j in range(shards):
        first = F.col("upto")[j - 1] * block if j else F.lit(0).cast("long")
        last = F.col("upto")[j] * block
        for turn in range(repeats):
            at = F.col("start") + turn * F.col("source_size")
            lo, hi = F.greatest(first, at), F.least(last, at + F.col("size"))
            spans.append(
                F.struct(F.lit(j).alias("shard"), F.lit(turn).alias("turn"), (lo - at).alias("start_word"), (hi - lo).alias("n_words"))
            )
    each = laid.select(F.col("id").alias(id_col), "source", F.explode(F.array(*spans)).alias("s")).where("s.n_words > 0")
    return each.select(id_col, "source", "s.*")
