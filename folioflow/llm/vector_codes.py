"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, found by partial-distance search.

Everything is integer arithmetic: a component x is floor(1024 * x), distances are sums of squared differences, and
means are rounded down, so results don't depend on how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, map_arrow, own

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances to a codebook are held at a time.
ROWS = 1024


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """The parts' places: consecutive, equal where the width allows, and to within one where not."""
    return [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance over the codebook, in integers; ties to the first."""
    n = len(book)
    spread = [n * sum(v * v for v in c) - sum(c) ** 2 for c in book.T.tolist()]
    return np.array(sorted(range(len(spread)), key=lambda i: (-spread[i], i)), dtype=np.int64)


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of each row of x, its squared distance); ties go to the lower index.

    After the first dimension every row's leader so far is measured whole, which gives the row's best complete
    distance. Then dimension after dimension is added for the entries that are left, and an entry goes once its sum
    strictly exceeds the best; the leader itself always stays.
    """
    n = len(x)
    if not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((x - book[sums.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for k, at in enumerate(order[1:]):
        sums += (x[row, at] - book[entry, at]) ** 2
        if k == 0:  # one more look: the leader after two dimensions is often the nearest
            first = np.searchsorted(row, np.arange(n))
            low = np.minimum.reduceat(sums, first)
            lead = entry[np.maximum.reduceat(np.where(sums == low[row], np.arange(len(row)), -1), first)]
            best = np.minimum(best, ((x - book[lead]) ** 2).sum(1))
        left = sums <= best[row]
        if not left.all():
            row, entry, sums = row[left], entry[left], sums[left]
    first = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(sums, first)
    hit = np.flatnonzero(sums == best[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(n))]], best


def _integers(column: pa.Array, width: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(column), width)
    if x.size and 4 * width * float(np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError("vector components so large that squared distances pass 64 bits")
    return x.astype(np.int64)


def _parts(batches, books, width: int):
    """(rows, their integer vectors, codes of each part, distance of each part) for ROWS rows at a time."""
    cuts = bounds(width, len(books))
    orders = [search_order(b) for b in books]
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            rows = batch.slice(lo, ROWS)
            x = _integers(rows.column("vec"), width)
            found = [nearest(x[:, a:b], book, order) for (a, b), book, order in zip(cuts, books, orders)]
            yield rows, x, [f[0] for f in found], [f[1] for f in found]


def _sums(held, width: int):
    """A task's sums: a row for each part, entry and place in the part, with the number of parts and their sum."""

    def run(batches):
        books = held.value
        cuts = bounds(width, len(books))
        sums = [np.zeros((len(k), b - a), np.int64) for k, (a, b) in zip(books, cuts)]
        counts = [np.zeros(len(k), np.int64) for k in books]
        for _, x, codes, _ in _parts(batches, books, width):
            for p, (a, b) in enumerate(cuts):
                np.add.at(sums[p], codes[p], x[:, a:b])
                counts[p] += np.bincount(codes[p], minlength=len(counts[p]))
        for p, n in enumerate(counts):
            at = np.flatnonzero(n)
            deep = sums[p].shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at) * deep, p, np.int32)), pa.array(np.repeat(at, deep).astype(np.int32)),
                    pa.array(np.tile(np.arange(deep), len(at)).astype(np.int32)), pa.array(np.repeat(n[at], deep)), pa.array(sums[p][at].ravel())
                ],
                names=["part", "entry", "place", "n", "total"]
            )

    return run


def _coded(held, width: int):
    def run(batches):
        for rows, _, codes, errors in _parts(batches, held.value, width):
            hexes = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c in codes))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("label"), pa.array(hexes, pa.string()), pa.array(sum(errors), pa.int64())],
                names=["id", "label", "code", "error"]
            )

    return run


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after `rounds` rounds, from vectors (id, vec) of one width.

    A codebook begins as the parts of the `entries` smallest ids (of an id's vectors the smallest; null ids last).
    What reaches the driver is `entries` vectors and, each round, one sum and count for each of their components.
    """
    spark = vectors.sparkSession
    seeds = vectors.groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.col("id").asc_nulls_last()).limit(entries)
    first = _integers(pa.array([list(r["vec"]) for r in seeds.collect()], pa.list_(pa.float64())), width)
    cuts = bounds(width, parts)
    books = [first[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)  # entries x width numbers
        each = map_arrow(vectors.select("vec"), _sums(held, width), "part int, entry int, place int, n long, total long")
        got = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        part, entry, place, n, total = (got.column(c).to_numpy() for c in ("part", "entry", "place", "n", "total"))
        books = [b.copy() for b in books]
        for p, book in enumerate(books):
            at = part == p
            book[entry[at], place[at]] = total[at] // n[at]
        held.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, code, error, label_error, codebooks_sha256) of each kept row, the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped. The width is that of the smallest
    kept id's vector; a vector of another width can't be compared and keeps its row with null code and error. Rows
    that repeat are rows of their own, but an id gives one first entry. Null labels count as one label. Other columns
    are left alone. An empty table gives an empty one and no codebooks. Raises where components are so large
    that a squared distance could pass 64 bits (beyond 185,000 at 64 components).

    A vector is read `rounds` + 2 times and never shuffled. Labels' errors are summed before they meet, and a label
    of very many rows gets its sum by broadcast.
    """
    assert entries <= 256, "a code has two hex digits"
    spark = vectors.sparkSession
    name = own("vec", vectors)
    # finite: x - x is 0, which no infinity, NaN or null gives
    good = vectors.withColumn(name, F.col(vector_col).cast("array<double>")).where(
        F.col(name).isNotNull() & F.forall(name, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    )
    good = good.select(F.col(id_col).alias("id"), F.col(name).alias("vec"), F.col(label_col).alias("label"))
    first = good.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).limit(1).collect()
    width = first[0]["n"] if first else 0
    same = good.where(F.size("vec") == width)
    books = train(same, width, parts, entries, rounds) if first else []
    kinds = dict(good.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    held = spark.sparkContext.broadcast(books)
    other = good.where(F.size("vec") != width).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut((map_arrow(same, _coded(held, width), schema) if first else other).unionByName(other))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = by_key(coded, sums, "label", "n").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
    return out, books
