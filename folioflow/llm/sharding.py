"""Sharding by balanced label propagation over links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums

SHARDS, ROUNDS = 24, 4


def _flows(wanted: dict[tuple[int, int], int], free: dict[int, int], size: dict[int, int], shards: int) -> dict[tuple[int, int], float]:
    """The share of each wanted flow that quotas allow: what goes in is met by what wants out and by unlinked documents that can give way."""
    into, out = [0] * shards, [0] * shards
    for (s, p), n in wanted.items():
        out[s] += n
        into[p] += n
    total = sum(size.values())
    room = [out[p] + free.get(p, 0) + max(0, total // shards - size.get(p, 0)) for p in range(shards)]
    return {(s, p): min(1.0, room[p] / into[p]) for (s, p) in wanted}


def label_propagation(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (any columns, with `hub`: the key by which documents are linked, null for none) with `shard`.

    Every round counts each hub's documents in each shard, moves documents towards the shard that holds most
    of their neighbours as far as quotas allow, and lets unlinked documents fill the shards that lost. After
    the rounds the counts of the shards are made equal to within one: unlinked documents move first, and
    linked ones only where those don't suffice. An empty table gives an empty one.

    State is one row a document without its text, cut after each round. Only shard-by-shard counts reach the
    driver. Hubs are counted with partial sums, and a hub of very many documents is split by the skew join.
    """
    names = nodes.columns
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("hub").cast("string"), F.col("tie").cast("string"))), F.lit(shards)).cast("int")
    # a first label by the hub: neighbours begin together where quotas will let them stay
    own = F.pmod(F.xxhash64(F.col("tie"), F.lit(1)), F.lit(shards)).cast("int")
    state = cut(
        nodes.withColumn("shard", F.when(F.col("hub").isNotNull() & (F.pmod(F.xxhash64("tie"), F.lit(2)) == 0), spread).otherwise(own))
    )
    for turn in range(rounds):
        linked = state.where("hub is not null")
        held = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = held.groupBy("hub").agg(
            F.max(
                F.struct(F.col("n"), F.pmod(F.xxhash64("hub", "shard"), F.lit(1 << 30)).alias("tie"), F.col("shard").alias("to"))
            ).alias("best"),
            F.count(F.lit(1)).alias("over")
        )
        best = best.where("over > 1").select("hub", F.col("best.to").alias("to"))
        # documents without links would meet in one task of the join, so they go around it
        free = state.where("hub is null").withColumn("to", F.col("shard"))
        stay = cut(linked.join(best, "hub", "left").withColumn("to", F.coalesce("to", "shard")).unionByName(free))
        rows = stay.groupBy(  # at most 2 x shards^2 rows
            "shard", "to", F.col("hub").isNull().alias("free")
        ).agg(F.count(F.lit(1)).alias("n")).collect()
        wanted = {(r["shard"], r["to"]): r["n"] for r in rows if r["shard"] != r["to"]}
        if not wanted:
            state = stay.drop("to")
            break
        free, size = {r["shard"]: r["n"] for r in rows if r["free"]}, {}
        for r in rows:
            size[r["shard"]] = size.get(r["shard"], 0) + r["n"]
        flows = [(s, p, f) for (s, p), f in _flows(wanted, free, size, shards).items()]
        allowed = F.broadcast(state.sparkSession.createDataFrame(flows, "shard int, to int, share double"))
        dice = F.pmod(F.xxhash64("tie", F.lit(turn + 11)), F.lit(1_000_000)) / 1_000_000
        moved = stay.join(allowed, ["shard", "to"], "left")
        state = moved.withColumn(
            "shard", F.when(dice < F.coalesce("share", F.lit(0.0)), F.col("to")).otherwise(F.col("shard"))
        ).drop("to", "share")
        state = cut(state)
    return _equalise(cut(state.select(*names, "shard")), shards)


def _equalise(state: DataFrame, shards: int) -> DataFrame:
    """Counts to within one. Who leaves a full shard: its unlinked documents first; places are dealt in a fixed order."""
    counts = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    total = sum(counts.values())
    order = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))  # the larger ones keep the larger quotas
    quota = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    over = [(s, counts[s] - quota[s]) for s in range(shards) if counts.get(s, 0) > quota[s]]
    if not over:
        return state
    room, at = [], 0
    for s in range(shards):
        if (n := quota[s] - counts.get(s, 0)) > 0:
            room.append((at, at + n, s))
            at += n
    spark = state.sparkSession
    ranked = cut(prefix_sums(state.withColumn("bound", F.col("hub").isNotNull()), ["shard", "bound"]))
    unbound = {  # a row a shard
        r["shard"]: r["n"] for r in ranked.where("not bound").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    leave, first = [], 0
    for s, n in over:
        leave.append((s, n, first, unbound.get(s, 0)))
        first += n
    ranked = ranked.join(F.broadcast(spark.createDataFrame(leave, "shard int, leaving long, first long, unbound long")), "shard", "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.when(F.col("bound"), F.coalesce("unbound", F.lit(0))).otherwise(0))
    ranked = ranked.withColumn("place", F.when(F.col("rank") < F.col("leaving"), F.col("first") + F.col("rank")))
    new = F.lit(None).cast("int")
    for lo, hi, s in room:  # as many as there are shards
        new = F.when((F.col("place") >= lo) & (F.col("place") < hi), F.lit(s)).otherwise(new)
    return ranked.withColumn("shard", F.coalesce(new, "shard")).select(*state.columns)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; documents with equal texts are linked.

    The law is `rows`: the shards' counts are at most one apart. size is the UTF-8 bytes of the text plus 8;
    a null text has none, the crc32 of nothing, and no links; empty texts are linked like others. slot counts
    from 0 without gaps in each shard. grown_shard is null under this law. Rows that repeat are rows of their own.
    """
    text = F.col(text_col).cast("string")
    body = F.coalesce(text, F.lit("")).cast("binary")
    nodes = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.when(text.isNotNull(), F.concat_ws(".", F.xxhash64(text), F.xxhash64(F.lit(1), text), F.octet_length(text))).alias("hub"),
    )
    nodes = nodes.withColumn("tie", F.xxhash64("id", "hub"))
    groups = nodes.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "hub", F.lit(True).alias("linked")
    )
    known = nodes.where("hub is not null").join(groups, "hub", "left").withColumn(
        "hub", F.when(F.col("linked"), F.col("hub"))
    ).drop("linked")
    nodes = known.unionByName(nodes.where("hub is null"))
    done = cut(label_propagation(nodes, shards, rounds))
    out = prefix_sums(done, ["shard"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard")
    )
