"""Staged checkpoint writes: a journal of pending and committed calls, reconciled after a cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import path_in, put_folder

PENDING, RESPONSE, COMMIT = "pending", "responses", "commits"
#: Columns of the three folders; batch is the folder that a row was written in.
SCHEMAS = {
    PENDING: "call string, fingerprint string, batch string", RESPONSE: "call string, payload string, batch string",
    COMMIT: "call string, sha256 string, batch string"
}


class Journal:
    """Calls of a plan with what is known of each, in a folder that all machines share.

    A batch of calls is written in three steps: its pending records (call, fingerprint of the request), the responses,
    and the commits (call, sha256 of the response). Each step is a folder that gets its name once it is whole, so a cut
    leaves earlier steps as they were, and a half-written one is never read. What a response says is only ever read
    through the journal; call ids are unique in a plan, and a call that is made again is a new pending record.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, kind: str) -> DataFrame:
        at = path_in(self.spark, f"{self.root}/{kind}")
        if not at.there():
            return self.spark.createDataFrame([], SCHEMAS[kind])
        return self.spark.read.schema(SCHEMAS[kind]).json(f"{self.root}/{kind}")

    def _write(self, rows: DataFrame, kind: str, batch: str) -> None:
        columns = [c.split()[0] for c in SCHEMAS[kind].split(", ") if not c.startswith("batch")]
        put_folder(rows.select(*columns), f"{self.root}/{kind}/batch={batch}")

    def state(self) -> DataFrame:
        """(call, fingerprint, payload, state) of every call that the journal names, by one aggregation over its three kinds of record.

        Of each kind a call's record of the last batch counts. committed: the response has the bytes that were
        committed. recovered: a whole response (JSON) to a pending request, without a commit since; it was written
        before a cut and can be taken over. uncertain: pending without a whole response; it may have to be made again.
        changed: the response's bytes aren't those that were committed, or nobody asked for it; no later step may use it.
        """
        rows = None
        for kind, column in ((PENDING, "fingerprint"), (RESPONSE, "payload"), (COMMIT, "sha256")):
            part = self._read(kind).where("call is not null").select("call", F.lit(kind).alias("kind"), F.struct("batch", F.col(column).alias("x")).alias("of"))
            rows = rows.unionByName(part) if rows else part
        last = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("of"))).alias(name)
        one = rows.groupBy("call").agg(last(PENDING, "asked"), last(RESPONSE, "got"), last(COMMIT, "done"))
        payload = F.col("got.x")
        since = F.coalesce("got.batch", F.lit(""))
        state = F.when(F.col("asked.batch") > since, "uncertain").when(
            F.col("done.batch") >= since,
            F.when(F.sha2(payload, 256).eqNullSafe(F.col("done.x")), "committed").otherwise("changed")
        ).when(F.col("got.batch").isNotNull() & ~F.col("got.batch").eqNullSafe(F.col("asked.batch")), "changed").when(
            payload.isNotNull() & F.try_parse_json(payload).isNotNull(), "recovered"
        ).otherwise("uncertain")
        one = one.select("call", F.col("asked.x").alias("fingerprint"), payload.alias("payload"), state.alias("state"))
        return one.withColumn("payload", F.when(F.col("state").isin("committed", "recovered"), F.col("payload")))

    def open_calls(self, plan: DataFrame) -> DataFrame:
        """plan (call, fingerprint and others) without what is answered: committed, or whole before a cut, for the same request.

        Raises where a response was changed since it was committed, as what comes after would build on it.
        """
        state = self.state()
        if not state.where("state = 'changed'").isEmpty():
            raise ValueError("a response has changed since it was committed")
        done = state.where("state in ('committed', 'recovered')").select("call", F.col("fingerprint").alias("_of"))
        return plan.join(done, (plan["call"] == done["call"]) & plan["fingerprint"].eqNullSafe(done["_of"]), "left_anti")

    def recover(self) -> None:
        """Commits every whole response that a cut left without its commit."""
        rows = self.state().where("state = 'recovered'").select("call", F.sha2("payload", 256).alias("sha256"))
        self._write(rows, COMMIT, self._batch())

    def run(self, plan: DataFrame, respond: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Makes the open calls of plan and gives (call, payload) of all of plan. respond: calls to (call, payload).

        What a cut left is taken over first. A request whose fingerprint has changed is made again.
        """
        self.recover()
        batch = self._batch()
        self._write(self.open_calls(plan), PENDING, batch)
        mine = self._read(PENDING).where(F.col("batch") == batch).drop("batch")  # what is asked is what was written down
        self._write(respond(plan.join(mine, ["call", "fingerprint"], "left_semi")), RESPONSE, batch)
        mine = self._read(RESPONSE).where(F.col("batch") == batch)
        self._write(mine.select("call", F.sha2("payload", 256).alias("sha256")), COMMIT, batch)
        return plan.select("call").join(self.state().where("state = 'committed'").select("call", "payload"), "call")

    def _batch(self) -> str:
        """A name after all others: batches are numbered by the pending and commit folders that are there."""
        taken = [n for kind in SCHEMAS for n in path_in(self.spark, f"{self.root}/{kind}").names() if n.startswith("batch=")]
        last = max((int(n[6:].split("-")[0]) for n in taken), default=0)
        return f"{last + 1:09d}-{uuid.uuid4().hex[:8]}"


def accounting(state: DataFrame, plan: DataFrame) -> DataFrame:
    """One row (answered, uncertain, untouched, least, most): calls that are still to be made, at least and at most."""
    rows = plan.select("call").distinct().join(state.select("call", "state"), "call", "left")
    n = lambda x: F.count_if(x).alias
    out = rows.agg(
        n(F.col("state").isin("committed", "recovered"))("answered"), n(F.col("state") == "uncertain")("uncertain"), n(F.col("state").isNull())("untouched")
    )
    return out.select("*", F.col("untouched").alias("least"), (F.col("untouched") + F.col("uncertain")).alias("most"))
