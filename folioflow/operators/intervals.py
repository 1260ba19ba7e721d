"""Intervals: the innermost unit around a place, and the definitions in force at a page. Equi-joins and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _blocks(lo: Column, hi: Column) -> Column:
    """lo to hi as blocks (level, block): each has 2**level places and begins at a multiple of that, two a level at most."""
    up = lambda k: -F.call_function("shiftright", -lo, k)  # noqa: E731  first block that begins at lo or later
    down = lambda k: F.call_function("shiftright", hi + 1, k)  # noqa: E731  first block that ends after hi
    levels = F.sequence(F.lit(0), F.floor(F.log2((hi - lo + 1).cast("double"))).cast("int") + 1)
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    block = lambda k, x: F.struct(k.alias("level"), x.alias("block"))
    of = lambda k: F.array(
        F.when((up(k) < down(k)) & odd(up(k)), block(k, up(k))), F.when((up(k) < down(k)) & odd(down(k)), block(k, down(k) - 1))
    )
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def innermost(rows: DataFrame, units: DataFrame, on: list[str], at: str, lo: str = "lo", hi: str = "hi", name: str = "uid") -> DataFrame:
    """D3: rows with `owner`, the unit of the same document that contains them and begins last (of several, the one that ends first).

    Units may be nested, touch or overlap in any way, and number any many, with a document key (`on`) or without one.
    Null outside all units, for null places and documents; every row stays once, repeated rows included. Units with
    null ends, or that end before they begin, hold nothing. Places are whole numbers.

    A unit is cut into at most two blocks a power of two; of the units that share a block only the innermost is kept,
    as partial maxima. A place lies in one block of each power that its document's units have, so places meet units by
    equality, and work grows with n log n, however deep units are nested or many they are. Places that are alike are
    looked up once.
    """
    keys = [f"_on{i}" for i in range(len(on))]
    spans = units.where(F.col(lo) <= F.col(hi)).select(
        *(F.col(c).alias(k) for c, k in zip(on, keys)), F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi"),
        F.col(name).alias("name")
    )
    unit = F.struct(F.col("_lo").alias("lo"), (-F.col("_hi")).alias("to"), "name")
    held = spans.select(*keys, F.explode(_blocks(F.col("_lo"), F.col("_hi"))).alias("b"), unit.alias("unit"))
    held = held.groupBy(*keys, "b.level", "b.block").agg(F.max("unit").alias("unit"))
    levels = held.groupBy(*keys).agg(F.collect_set("level").alias("levels"))  # as many as a long has bits
    places = rows.select(*(F.col(c).alias(k) for c, k in zip(on, keys)), F.col(at).cast("long").alias("_at")).where("_at is not null").distinct()
    met = places.join(levels, keys) if keys else places.crossJoin(F.broadcast(levels.where("size(levels) > 0")))  # one row
    met = met.select(*keys, "_at", F.explode("levels").alias("level")).withColumn("block", F.expr("shiftright(_at, level)"))
    best = met.join(held, [*keys, "level", "block"]).groupBy(*keys, "_at").agg(F.max("unit")["name"].alias("owner"))
    same = [rows[c] == best[k] for c, k in zip(on, keys)] + [rows[at].cast("long") == best["_at"]]
    return rows.join(best, same, "left").select(*(rows[c] for c in rows.columns), "owner")


def versions(definitions: DataFrame, doc: list[str], page: str, name: str, attempt: str | None = None) -> DataFrame:
    """Definitions with `since` and `until`, the first and last page on which each is the last one of its name.

    A definition holds from the page after its own up to the page of the next one of its name, which still sees it;
    the last one has no end (null). With `attempt`, only those of a page's last attempt count, whatever their names:
    drafts that were tried again leave nothing behind. Of several on a page the last by all their columns counts. As
    many rows as there are definitions in force. Rows with a null name or page hold nowhere and go.
    """
    rows = definitions.where(F.col(name).isNotNull() & F.col(page).isNotNull())
    if attempt:
        last = definitions.groupBy(*doc, page).agg(F.max(attempt).alias("_last"))
        rows = rows.join(last, [*doc, page]).where(F.col(attempt).eqNullSafe(F.col("_last"))).drop("_last")
    rest = [c for c in rows.columns if c not in (*doc, page, name)]
    one = rows.groupBy(*doc, page, name).agg(F.max(F.struct(*rest)).alias("_of")) if rest else rows.distinct()
    one = one.select(*doc, page, name, *(["_of.*"] if rest else []))
    after = F.lead(page).over(W.partitionBy(*doc, name).orderBy(page))
    return one.withColumns({"since": F.col(page) + 1, "until": after})


def in_force(uses: DataFrame, held: DataFrame, doc: list[str], page: str, name: str, value: str, out: str = "found") -> DataFrame:
    """Uses with the value that their name has on their page, null where it has none there yet. held: see versions.

    Uses and definitions of a name are sorted together once, so a name that is defined and used on every page costs
    no more than its rows. A definition on a use's own page doesn't count. Nulls among page or name find nothing.
    """
    kept = [F.col(c).alias(f"_u{i}") for i, c in enumerate(uses.columns)]
    blank = [F.lit(None).cast(f.dataType).alias(f"_u{i}") for i, f in enumerate(uses.schema.fields)]
    key = lambda c, frame: F.col(c).cast("string").alias(f"_k{frame}")
    a = uses.select(*(key(c, i) for i, c in enumerate([*doc, name])), F.col(page).alias("_p"), F.lit(0).alias("_kind"),
                    F.lit(None).cast(held.schema[value].dataType).alias("_v"), F.lit(False).alias("_set"), *kept)
    b = held.select(*(key(c, i) for i, c in enumerate([*doc, name])), F.col(page).alias("_p"), F.lit(1).alias("_kind"),
                    F.col(value).alias("_v"), F.lit(True).alias("_set"), *blank)
    keys = [f"_k{i}" for i in range(len(doc) + 1)]
    before = W.partitionBy(*keys).orderBy("_p", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_set"), F.struct("_v")), True).over(before)
    usable = F.col("_p").isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    both = a.unionByName(b).withColumn("_seen", F.when(usable, seen["_v"])).where("_kind = 0")
    return both.select(*(F.col(f"_u{i}").alias(c) for i, c in enumerate(uses.columns)), F.col("_seen").alias(out))
