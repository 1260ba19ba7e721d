"""Substring dedup: passages that repeat exactly or nearly across documents, wherever they stand in a line.

A text's words are cut into units where the words themselves say so: before a word whose mark is the least among
the REACH words on either side. The same passage is thus cut alike in every document that holds it, whatever stands
around it and wherever its lines break. Units are the paragraphs that are compared, all of them, of every length:

1. MinHash bands bring units together. With BANDS bands of ROWS rows, a pair of similarity s meets with probability
   1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8. Sets that can be near any but their equals only have no bands.
2. Units that meet in a list are compared there by exact Jaccard similarity of their word shingles. Members of a long
   list meet in lists of FINE_BANDS bands of FINE_ROWS rows instead (0.998 at 0.8, but 0.26 at 0.4); of those, lists
   that are still long are compared by pairs of parts. Nothing is capped.
3. Connected components of the verified pairs say which units are the same. Of a component that stands in several
   documents all places but the first are removed.
4. Neighbouring repeated units merge into passages; shorter ones than least_words (phrases that many documents
   share, not copied passages) stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_arrow, own, release
from .graph import components
from .jaccard_join import PART, PERCENT, SHINGLE, _verify
from .shingles import MARK_PRIME, chunks, marked_words, mix, windows

BANDS, ROWS, FINE_BANDS, FINE_ROWS = 6, 2, 12, 4
#: Words on either side that a cut's mark is compared with; factors of the three words whose marks are one; least words of a passage.
REACH, MARK_FACTORS, LEAST_WORDS = 7, (399_165_290, 221_867_437, 92_652_833), 25
_FACTORS = np.random.default_rng(411).integers(1, 2**63, FINE_BANDS * FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def unit_starts(mark: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers of the words with which units begin. Each text with words begins one."""
    n = len(mark)
    three = np.concatenate([mark, [0, 0]])
    inside = np.repeat(before[1:], np.diff(before)) - np.arange(n)  # words from here to the text's end
    three = MARK_FACTORS[0] * mark + MARK_FACTORS[1] * np.where(
        inside > 1, three[1 : n + 1], 0
    ) + MARK_FACTORS[2] * np.where(inside > 2, three[2:], 0)
    three %= MARK_PRIME
    cut_at = (inside > REACH) & (np.arange(n) - np.repeat(before[:-1], np.diff(before)) >= REACH)
    for k in range(1, REACH + 1):
        cut_at[k:] &= three[k:] < three[:-k]
        cut_at[:-k] &= three[:-k] <= three[k:]
    cut_at[before[:-1][np.diff(before) > 0]] = True
    return np.flatnonzero(cut_at)


class Units:
    """The units of some texts: their first words, sets of shingles, and nodes (a hash of the set)."""

    def __init__(self, texts: list[bytes | None], k: int = SHINGLE):
        h, self.before, self.start, self.end, mark = marked_words(texts)
        self.at = unit_starts(mark, self.before)
        self.sizes = np.diff(np.concatenate([self.at, [len(h)]]))
        self.of_text = np.searchsorted(self.at, self.before)  # units before each text and in all
        g, first = windows(h, np.concatenate([self.at, [len(h)]]), k)
        owner = np.repeat(np.arange(len(self.at)), np.diff(first))
        # sorted within units by their upper bits, which nearly always suffice
        bits = int(len(self.at)).bit_length()
        key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (g >> np.uint64(bits))
        order = np.argsort(key)
        if bits and (np.diff(key[order]) == 0)[(np.diff(g[order]) != 0)].any():
            order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        self.shingles, owner = g[new], owner[new]
        self.count = np.bincount(owner, minlength=len(self.at))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        with np.errstate(over="ignore"):
            total = np.add.reduceat(
                mix(self.shingles + np.uint64(0x9E3779B97F4A7C15)), self.first[:-1]
            ) if len(self.at) else np.zeros(0, np.uint64)
            self.node = mix(total + self.count.astype(np.uint64)).view(np.int64)

    def bands(self, units: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A row of list keys for each of the units."""
        out = np.zeros((len(units), bands), np.uint64)
        if not len(units):
            return out.view(np.int64)
        some = np.concatenate(
            [self.shingles[self.first[i] : self.first[i + 1]] for i in units]
        ) if len(units) < len(self.at) else self.shingles
        at = np.concatenate([[0], np.cumsum(self.count[units])[:-1]])
        with np.errstate(over="ignore"):
            for k in range(bands * rows):
                low = np.minimum.reduceat(((some * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), at)
                out[:, k // rows] = mix(out[:, k // rows] * np.uint64(31) + low + np.uint64(k + rows * 1000))
        return out.view(np.int64)


def _entries(percent: int):
    """(list, node) of each unit and band, once for units that are alike in a batch.

    Units of u shingles have none where u / (u + 1) is less than `percent`: only their equals are near them.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for lo, hi in chunks(texts):
                u = Units(texts[lo:hi])
                lists = u.bands(np.arange(len(u.at)), BANDS, ROWS)
                _, one = np.unique(u.node, return_index=True)
                one = one[100 * u.count[one] >= percent * (u.count[one] + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[one].reshape(-1)), pa.array(np.repeat(u.node[one], BANDS))], names=["list", "node"]
                )

    return run


def _units():
    """Of each text, its units' first words, sizes and nodes."""

    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for lo, hi in chunks(texts):
                u = Units(texts[lo:hi])
                at = pa.array(u.of_text, pa.int32())
                starts = u.at - np.repeat(u.before[:-1], np.diff(u.of_text))
                lists = [
                    pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in (
                        (u.node, pa.int64()), (starts, pa.int32()), (u.sizes, pa.int32())
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("version").slice(lo, hi - lo), *lists],
                    names=["id", "version", "nodes", "starts", "sizes"]
                )

    return run


def _sets():
    """(node, set, fine): the shingles and fine lists of the units that are asked for."""

    def run(batches):
        for batch in batches:
            asked, texts = batch.column("asked").to_pylist(), batch.column("t").to_pylist()
            for lo, hi in chunks(texts):
                u = Units(texts[lo:hi])
                some = np.array([u.of_text[i] + k for i in range(hi - lo) for k in sorted(asked[lo + i])], dtype=np.int64)
                fine = pa.array(u.bands(some, FINE_BANDS, FINE_ROWS).reshape(-1))
                fine = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * FINE_BANDS, pa.int32()), fine)
                sets = pa.array([u.shingles[u.first[i] : u.first[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(u.node[some]), sets, fine], names=["node", "set", "fine"])

    return run


def _lists(members: DataFrame) -> DataFrame:
    """(list, n) of the lists of (list, node) with several members; of lists with the same members, one."""
    lists = members.groupBy("list").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("s")
    )
    return lists.where("n > 1").groupBy("n", "a", "b", "s").agg(F.min("list").alias("list")).select("list", "n")


def _members(base: DataFrame, percent: int) -> DataFrame:
    """(list, node) of the lists that hold several nodes."""
    # one exchange: both sides of the join read it
    entries = map_arrow(base.select("t"), _entries(percent), "list long, node long").repartition("list")
    shared = entries.groupBy("list").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("list")
    return cut(entries.join(shared.hint("shuffle_hash"), "list").distinct())


def _near(base: DataFrame, places: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the units that are like another that isn't their equal."""
    asked = members.select("node").distinct()
    one = places.join(asked, "node").groupBy("node").agg(F.min(F.struct("id", "version", "unit")).alias("p"))
    asked = one.groupBy(  # of one document
        F.col("p.id").alias("_id"), F.col("p.version").alias("_version")
    ).agg(F.collect_list("p.unit").alias("asked"))
    wanted = base.join(
        asked.hint("shuffle_hash"), base["id"].eqNullSafe(asked["_id"]) & (base["version"] == asked["_version"])
    ).select("t", "asked")
    sets = cut(map_arrow(wanted, _sets(), "node long, set binary, fine array<long>").dropDuplicates(["node"]))

    lists = cut(_lists(members))
    short = members.join(lists.where(F.col("n") <= PART), "list").select(F.col("list").alias("grp"), "node", F.lit(1).alias("parts"))
    long = members.join(lists.where(F.col("n") > PART), "list").select("node").distinct()
    fine = sets.join(long, "node").select(F.explode("fine").alias("list"), "node")
    long = fine.join(_lists(fine), "list").select(F.col("list").alias("grp"), "node", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = short.unionByName(long).join(sets.select("node", "set"), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", "set")
    rows = rows.repartition(F.col("grp"), F.col("i"), F.col("j")).sortWithinPartitions("grp", "i", "j")
    return components(map_arrow(rows, _verify(percent), "a long, b long"))


def _repeated_units(docs: DataFrame, id_col: str, text_col: str, least_words: int, percent: int) -> DataFrame:
    """(id, version, island, start, n_words, first, removed): each unit of a passage of least_words words or more."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"),
        F.col(text_col).cast("string").cast("binary").alias("t")
    ).where("t is not null")
    found = cut(map_arrow(base, _units(), f"id {kind}, version long, nodes array<long>, starts array<int>, sizes array<int>"))
    each = F.posexplode(
        F.arrays_zip(F.col("nodes").alias("node"), F.col("starts").alias("start"), F.col("sizes").alias("n_words"))
    ).alias("unit", "u")
    places = found.select("id", "version", each).select("id", "version", "unit", "u.*")

    document = F.xxhash64("id", "version")
    equal = places.groupBy("node").agg(F.min(document).alias("a"), F.max(document).alias("b")).where("a <> b").select("node")
    members = _members(base, percent)
    release(docs.sparkSession)  # the lists of all units
    # most units stand in one place and meet no other: what follows is about the rest
    places = cut(places.join(equal.union(members.select("node")).distinct(), "node"))
    near = _near(base, places, members, percent)
    nodes = equal.join(near, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
    repeated = cut(places.join(nodes, "node").drop("node").distinct())
    here = F.struct("id", "version", "unit")
    firsts = repeated.groupBy("component").agg(
        F.min(here).alias("first"), F.min(document).alias("a"), F.max(document).alias("b")
    ).where("a <> b").drop("a", "b")
    units = repeated.join(firsts, "component").withColumn("removed", here != F.col("first")).drop("component")
    units = units.withColumn("island", F.col("unit") - F.row_number().over(W.partitionBy("id", "version").orderBy("unit")))
    units = units.withColumn("span", F.sum("n_words").over(W.partitionBy("id", "version", "island")))
    return units.where(F.col("span") >= least_words).drop("span", "unit")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, start_word, n_words, n_removed, first_id): every passage of which each unit stands in another document, too.

    start_word counts a text's words from 0; n_removed counts the words of its units that aren't the first of their
    component by (id, text hash, place); first_id is the smallest id in which a unit of it comes first. A passage is
    a longest run of such units and has at least least_words words; with 1, every such unit counts. What repeats
    only within one document is none. A text of fewer words than a shingle is one unit and one whole sequence. Null and
    empty texts and texts without words give nothing. Rows alike in id and text are one document; rows that share
    only an id are several.
    """
    units = _repeated_units(docs, id_col, text_col, least_words, percent)
    spans = units.groupBy("id", "version", "island").agg(
        F.min("start").alias("start_word"), F.sum("n_words").cast("int").alias("n_words"),
        F.sum(F.when(F.col("removed"), F.col("n_words")).otherwise(0)).cast("int").alias("n_removed"), F.min("first.id").alias("first_id")
    )
    return spans.select(F.col("id").alias(id_col), "start_word", "n_words", "n_removed", "first_id")


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without runs of words, given as (first word, words), each with the white space after it."""
    _, _, start, _ = marked_words([text], False)[:4]
    edge = [*start.tolist(), len(text)]
    out, at = [], 0
    for first, n in sorted(gone):
        out.append(text[at : edge[first]])
        at = edge[min(first + n, len(start))]
    return b"".join([*out, text[at:]])


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """docs whose texts lack the units of repeated_passages that aren't the first of their component.

    A unit goes with the white space after it. Texts in which nothing repeats, null and empty texts, all rows and
    all other columns stay as they are. The text column is a string.
    """
    key, version, gone = own("_id", docs), own("_version", docs), own("_gone", docs)
    cuts = _repeated_units(docs, id_col, text_col, least_words, percent).where("removed").groupBy(
        F.col("id").alias(key), F.col("version").alias(version)
    ).agg(  # of one document
        F.collect_list(F.struct("start", "n_words")).alias(gone)
    )
    ready = docs.withColumn(text_col, F.col(text_col).cast("string"))
    ready = ready.join(
        cuts.hint("shuffle_hash"), ready[id_col].eqNullSafe(cuts[key]) & (F.xxhash64(ready[text_col]) == cuts[version]), "left"
    ).drop(key, version)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [
                t if not some else without(
                    t.encode("utf-8", "surrogatepass"), [(x["start"], x["n_words"]) for x in some]
                ).decode("utf-8", "surrogatepass") for t, some in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names=names
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields if f.name != gone)
    return map_arrow(ready, run, schema)
