"""N-gram Jaccard join with set-relation skipping, down to connected components.

1. Texts are dealt into blocks by a hash. Each block sends its shingles, by ranges of their hash, to be
   counted; the counts of shingles that repeat come back to the blocks that hold them. Nothing is broadcast.
2. Each set is ordered by (document count, hash). Its first |s| - ceil(0.8 |s|) + 1 shingles that repeat are
   its entries in the index lists. A list is split into blocks by set size; an entry goes only to the blocks
   whose sizes its own position still allows, so the other blocks are skipped.
3. Sets that share a block of a list form groups (first within a block of texts, then by components over the
   nodes alone). Every set goes once to its group; a large group is split into pairs of parts, so no task holds
   more than two parts.
4. In a part, a set's overlaps are counted over the part's index; a similar set's answers are then derived
   from those already known: sets in one component need no answer, and distances from the answered sets most
   similar to it that differ by more than the threshold rule a pair out (Jaccard distance is a metric). Only a
   spanning forest of the links leaves.

Exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freeing, map_arrow, own, ship
from .graph import components
from .shingles import shingle_sets

SHINGLE, PERCENT = 5, 80
#: Text bytes of a block; shingles of a hash range; sets of a part; answered sets from which a set's answers are derived.
BLOCK_BYTES, RANGE_SHINGLES, PART, PIVOTS = 8 << 20, 1 << 20, 384, 8


def _sets(texts: list, k: int):
    return list(shingle_sets(texts, k))


def _count_blocks(k: int, bits: int):
    """(range, block, the block's distinct shingles in the range, how many texts hold each)."""

    def run(batches):
        for batch in batches:
            blocks, texts = batch.column("block").to_numpy(), batch.column("t").to_pylist()
            sets = _sets(texts, k)
            for b in np.unique(blocks):
                own = [sets[i] for i in np.flatnonzero(blocks == b)]
                toks, n = np.unique(np.concatenate(own) >> np.uint64(32 - bits), return_counts=True)
                n = np.minimum(n, 65535).astype(np.uint16)
                at = np.searchsorted(toks, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32))
                low = (toks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                parts = [(r, t, c) for r, (t, c) in enumerate(zip(np.split(low, at), np.split(n, at))) if len(t)]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x[0] for x in parts], pa.int32()), pa.array([int(b)] * len(parts), pa.int32()),
                            pa.array([x[1].tobytes() for x in parts]), pa.array([x[2].tobytes() for x in parts])
                        ],
                        names=["range", "block", "toks", "n"]
                    )

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one hash range: for every block, its shingles that more than one text of the whole table holds, and their counts."""
    rows = table.to_pydict()
    toks = [np.frombuffer(x, np.uint32) for x in rows["toks"]]
    every = np.concatenate(toks)
    uniq, inverse = np.unique(every, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.uint16) for x in rows["n"]])).astype(np.int64)
    out, at = {"range": [], "block": [], "toks": [], "n": []}, 0
    for r, b, t in zip(rows["range"], rows["block"], toks):
        n = total[inverse[at : at + len(t)]]
        at += len(t)
        if (many := n > 1).any():
            out["range"].append(r)
            out["block"].append(b)
            out["toks"].append(t[many].tobytes())
            out["n"].append(np.minimum(n[many], 2**32 - 1).astype(np.uint32).tobytes())
    return pa.table(out, schema=pa.schema([("range", pa.int32()), ("block", pa.int32()), ("toks", pa.binary()), ("n", pa.binary())]))


def size_class(n: float, percent: int) -> int:
    return int(math.floor(math.log(n) / math.log(100 / percent) + 1e-9))


def index_entries(s: np.ndarray, count: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(shingle, size class) of the blocks of index lists that a set enters. count: texts that hold each shingle of s."""
    n = len(s)
    prefix = n - -(-percent * n // 100) + 1
    order = np.lexsort((s, count))[:prefix]
    own = size_class(n, percent)
    low = (100 / percent) ** (own + 1)
    out = []
    for place in np.flatnonzero(count[order] > 1):
        token = int(s[order[place]].astype(np.int64))
        out.append((token, own))
        # the largest set that can still link if this is the first shingle in common
        most = (n - place) * (100 + percent) / percent - n
        if most + 1 >= low:
            out.append((token, own + 1))
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _index(k: int, bits: int, percent: int):
    """A row for each text of a block: its node and, if it enters index lists, its set and the block's group of it.

    Sets of a block that share blocks of lists are one group there, named by one of them; all their entries leave
    once, with the first row of that one. So many alike sets enter a list as one.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pydict()
        # a block counted in several batches has several rows of a range, and a shingle may stand in each
        toks = np.concatenate(
            [
                np.zeros(0, np.uint64),
                *(
                    np.frombuffer(t, np.uint32).astype(np.uint64) + (
                        np.uint64(r) << np.uint64(32)
                    ) for r, t in zip(rows["range"], rows["toks"])
                )
            ]
        )
        total = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(n, np.uint32) for n in rows["n"])]).astype(np.int64)
        toks, at = np.unique(toks, return_index=True)
        total = total[at]
        out: dict[str, list] = {"n": [], "node": [], "root": [], "tokens": [], "classes": [], "set": []}
        number: dict[int, int] = {}  # of the nodes that enter lists
        lists: dict[tuple[int, int], int] = {}
        forest, first = Forest(0), []
        for row, s in enumerate(shingle_sets(left.column("t").to_pylist(), k)):
            entries = []
            if len(s):
                ids = s >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(toks, ids), max(len(toks) - 1, 0))
                count = np.where(toks[at] == ids, total[at], 1) if len(toks) else np.ones(len(s), np.int64)
                if (count > 1).sum() * 100 >= percent * len(s):  # else no set can hold enough of this one
                    entries = index_entries(s, count, percent)
            node = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
            if entries and node not in number:
                number[node] = len(forest.up)
                forest.up.append(len(forest.up))
                first.append(row)
                for e in entries:
                    forest.link(number[node], lists.setdefault(e, number[node]))
            out["n"].append(len(s))
            out["node"].append(node)
            out["set"].append(s.tobytes() if entries else None)
        of_root: dict[int, list] = {}
        for e, i in lists.items():
            of_root.setdefault(forest.root(i), []).append(e)
        names = {i: node for node, i in number.items()}
        for row, (node, s) in enumerate(zip(out["node"], out["set"])):
            i = number[node] if s is not None else None
            own = of_root[i] if i is not None and forest.root(i) == i and first[i] == row else []
            out["root"].append(None if i is None else names[forest.root(i)])
            out["tokens"].append([e[0] for e in own])
            out["classes"].append([e[1] for e in own])
        types = {
            "n": pa.int64(), "node": pa.int64(), "root": pa.int64(), "tokens": pa.list_(pa.int64()), "classes": pa.list_(pa.int32()),
            "set": pa.binary()
        }
        return pa.table(
            [left.column("id"), left.column("version"), *(pa.array(out[c], types[c]) for c in types)], names=["id", "version", *types]
        )

    return run


def links_within(sets: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with `first`, the links of the first so many are complete, others may be left out."""
    n, forest, out = len(sets), Forest(len(sets)), []
    size = np.array([len(s) for s in sets])
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * inter >= percent * (size.sum() - inter) else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    lists, owner = flat[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    stop = np.concatenate([new[1:], [len(lists)]])
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(new)), stop - new)
    at = np.concatenate([[0], np.cumsum(size)])
    limit, apart, answered = 1 - percent / 100, np.zeros((0, n)), 0
    component = np.arange(n)
    for x in range(n if first is None else first):
        open_ = component != component[x]
        open_ &= (size * 100 >= percent * size[x]) & (size[x] * 100 >= percent * size)
        if answered and open_.any():  # what the distances to the most similar answered sets rule out
            own = apart[:answered, x]
            nearest = np.argpartition(own, PIVOTS - 1)[:PIVOTS] if answered > PIVOTS else np.arange(answered)
            open_ &= ~(np.abs(apart[nearest] - own[nearest, None]) > limit + 1e-9).any(0)
        if not open_.any():
            continue
        own = number[at[x] : at[x + 1]]
        lo, length = new[own], (stop - new)[own]
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        inter = np.bincount(owner[where], minlength=n)
        union = size + size[x] - inter
        if answered == len(apart):
            apart = np.vstack([apart, np.empty((max(PIVOTS, answered), n))])
        apart[answered] = 1 - inter / np.maximum(union, 1)
        answered += 1
        joined = [(x, int(y)) for y in np.flatnonzero((100 * inter >= percent * union) & open_) if forest.link(x, int(y))]
        if joined:
            out += joined
            component = np.array([forest.root(i) for i in range(n)])
    return out


def linked_pairs(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Of many pairs of sets at once, whether they link."""
    both = np.frombuffer(b"".join([*a, *b]), np.uint64)
    size = np.array([len(x) // 8 for x in [*a, *b]])
    pair = np.repeat(np.concatenate([np.arange(len(a))] * 2), size)
    order = np.lexsort((both, pair))
    both, pair = both[order], pair[order]
    same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
    inter = np.bincount(pair[1:][same], minlength=len(a))
    return 100 * inter >= percent * (size[: len(a)] + size[len(a) :] - inter)


def _verify(percent: int):
    """Rows come ordered by (grp, i, j); a pair of parts is answered when its last row has come. Groups of two are answered many at a time."""

    def answer(key, rows):
        node, part, sets = zip(*rows)
        order = np.lexsort((node, np.array(part) != key[1]))
        first = None if key[1] == key[2] else sum(p == key[1] for p in part)
        found = links_within([np.frombuffer(sets[i], np.uint64) for i in order], percent, first)
        return [(node[order[x]], node[order[y]]) for x, y in found]

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            grp, i, j, node, part = (batch.column(c).to_numpy() for c in ("grp", "i", "j", "node", "part"))
            sets = batch.column("set").to_pylist()
            new = np.flatnonzero((grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges, out, twos = [0, *new.tolist(), len(grp)], [], []
            for lo, hi in zip(edges, edges[1:]):
                now = (grp[lo], i[lo], j[lo])
                if now != key:
                    if len(held) > 1:
                        out += answer(key, held)
                    key, held = now, []
                    if hi - lo == 2 and hi < len(grp):
                        twos.append(lo)
                        continue
                held += zip(node[lo:hi].tolist(), part[lo:hi].tolist(), sets[lo:hi])
            if twos:
                good = linked_pairs([sets[k] for k in twos], [sets[k + 1] for k in twos], percent)
                out += [(int(node[k]), int(node[k + 1])) for k, x in zip(twos, good) if x and (i[k] == j[k] or part[k] != part[k + 1])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if len(held) > 1 and (out := answer(key, held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, version, n, first), a row for each row of docs: first is the smallest (id, version) of its component, null without any."""
    kind = dict(docs.dtypes)[id_col]
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"),
        F.col(text_col).cast("string").cast("binary").alias("t")
    )
    total = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    most = math.isqrt(total // 6000) + 1  # blocks x ranges stay far below the number of shingles
    blocks = max(1, min(-(-total // BLOCK_BYTES), most))
    bits = max(1, min(24, math.ceil(math.log2(max(2, min(total / 6 / RANGE_SHINGLES, most))))))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)).cast("int")).repartition(F.col("block"))
    index = freeing(_index(shingle, bits, percent))
    counted = map_arrow(dealt, _count_blocks(shingle, bits), "range int, block int, toks binary, n binary")
    back = counted.groupBy("range").applyInArrow(lambda table: freeing(_repeated)(table), "range int, block int, toks binary, n binary")
    indexed = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        lambda left, right: index(left, right),
        f"id {kind}, version long, n long, node long, root long, tokens array<long>, classes array<int>, set binary"
    )
    indexed = cut(indexed)

    entries = indexed.where(F.size("tokens") > 0).select(
        "root", F.explode(F.arrays_zip("tokens", "classes")).alias("e")
    ).select("root", F.xxhash64("e.tokens", "e.classes").alias("list"))
    pivots = entries.groupBy("list").agg(F.min("root").alias("pivot"), F.max("root").alias("last")).where("pivot <> last").drop("last")
    near = entries.join(pivots, "list").where("root <> pivot").select(F.col("root").alias("a"), F.col("pivot").alias("b"))
    near = near.union(indexed.where("node <> root").select("node", "root")).distinct()
    groups = cut(components(near).withColumnRenamed("component", "grp"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / PART).cast("int"))
    groups = groups.join(sizes.select("grp", "parts"), "grp")

    sets = indexed.where("set is not null").select("node", "set").dropDuplicates(["node"]).join(groups, "node")
    sets = sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", "set")
    sets = sets.repartition(F.col("grp"), F.col("i"), F.col("j")).sortWithinPartitions("grp", "i", "j")
    links = map_arrow(sets, _verify(percent), "a long, b long")

    found = components(links)
    place = F.when(F.col("id").isNotNull(), F.struct("id", "version"))
    firsts = indexed.where("node is not null").groupBy("node").agg(F.min(place).alias("first"))
    firsts = firsts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = firsts.groupBy("component").agg(F.min("first").alias("lowest"))
    named = firsts.join(lowest, "component").select("node", F.col("lowest").alias("first"))
    out = indexed.select("id", "version", "n", "node").join(named, "node", "left")
    return out.select("id", "version", "n", F.when(F.col("node").isNull(), place).otherwise(F.col("first")).alias("first"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of word shingles; a text
    of fewer words is one shingle; null texts and texts without words have none and link with nothing. Equal
    sets are one node, so copies are never paired. component_id is the smallest id of the component; ids are
    integers; a row with a null id links like any other, and its component is null only if no row of it has an id.
    """
    rows = _grouped(docs, id_col, text_col, shingle, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """docs with one document of each component: that with the smallest id, of equal ids that whose text's hash is smallest.

    Rows alike in id and text are one document and stay or go together; a row that shares only its id with a
    removed one stays. Rows without an id, null texts and texts without words stay. All columns stay as they are.
    """
    rows = _grouped(docs, id_col, text_col, shingle, percent)
    key, version = own("_id", docs), own("_version", docs)
    gone = rows.where(
        F.col("id").isNotNull() & (F.struct("id", "version") != F.col("first"))
    ).select(F.col("id").alias(key), F.col("version").alias(version)).distinct()
    return docs.join(
        gone.hint("shuffle_hash"), (docs[id_col] == gone[key]) & (F.xxhash64(docs[text_col].cast("string")) == gone[version]), "left_anti"
    )
