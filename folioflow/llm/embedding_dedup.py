"""Embedding near-dedup: inverted lists, product-quantised residuals, table-lookup distances and exact rerank.

A vector is a member of the list whose centroid is nearest and a query of the lists that can hold a vector near it: a
vector of list b lies on b's side of the plane between b's centroid and that of the query's own list a. Along that
plane's normal, a vector at the threshold's angle stands s / sqrt(width - 1) from the query in the mean square, s the
sine; lists farther off than SPREAD times that (and never nearer than the threshold's distance proves) are not probed.
So the number of probes follows the data and the number of lists. In a list, only the known coding error rules a pair
out before its exact cosine. At SPREAD 4.5 a pair just at the threshold is lost with a probability of some 3e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .graph import components

COSINE = 0.93
#: Vectors that the coarse centroids and the codebooks are trained on, at most; vectors a list should hold; subspaces
#: and codes of each; members of a list's part, and queries that meet it in one task.
SAMPLE, PER_LIST, SUBSPACES, CODES, PART, QUERIES = 16_384, 256, 8, 64, 4096, 65_536
#: How far, in root mean squares, a near vector is looked for beyond the plane between two lists.
SPREAD = 4.5


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Coarse centroids and, for each subspace, codes of the residuals. One for each width of vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = _kmeans(sample, lists)
        rest = sample - self.coarse[self.near(sample, 1)[:, 0]]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], CODES) for a, b in zip(self.cuts, self.cuts[1:])]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def probes(self, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(nearest list of each unit vector, whether it probes each list before that one)."""
        along = x @ self.coarse.T
        square = (self.coarse**2).sum(1)
        d = 1 + square - 2 * along
        cell, row = d.argmin(1), np.arange(len(x))
        between = np.sqrt(np.maximum(1e-18, square[:, None] + square - 2 * self.coarse @ self.coarse.T))[cell]
        plane = (d - d[row, cell][:, None]) / (2 * between)
        normal = (along - along[row, cell][:, None]) / between
        spread = SPREAD * math.sqrt(max(0.0, 1 - cosine**2) / max(1, x.shape[1] - 1))
        bound = np.minimum((cosine - 1) * normal + spread, math.sqrt(max(0.0, 2 - 2 * cosine)))
        return cell, (plane <= bound + 1e-6) & (np.arange(len(self.coarse)) < cell[:, None])

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each vector and what its codes stand for)."""
        rest = x - self.coarse[cell]
        codes = np.stack(
            [((b**2).sum(1) - 2 * rest[:, s:e] @ b.T).argmin(1) for b, s, e in zip(self.books, self.cuts, self.cuts[1:])], axis=1
        ).astype(np.uint8)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - back, axis=1)

    def tables(self, q: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each subspace, the squared distance of each query's residual to each code."""
        rest = q - self.coarse[cell]
        return [
            (
                (rest[:, s:e] ** 2).sum(1)[:, None] - 2 * rest[:, s:e] @ b.T + (b**2).sum(1)
            ) for b, s, e in zip(self.books, self.cuts, self.cuts[1:])
        ]


def _assign(blob, cosine: float):
    """The list that holds each vector, its codes there and their error, and the lists before it that it has to probe."""

    def run(batches):
        indexes = blob.value
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                index = indexes[width]
                own_rows = np.flatnonzero(widths == width)
                step = max(64, (1 << 20) // len(index.coarse))
                for lo in range(0, len(own_rows), step):
                    part = batch.take(pa.array(own_rows[lo : lo + step]))
                    x = part.column("vec").flatten().to_numpy().astype(float).reshape(len(part), width)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    cell, probed = index.probes(x, cosine)
                    codes, error = index.encode(x, cell)
                    at, lists = np.nonzero(probed)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(at, np.arange(len(part) + 1)), pa.int32()), pa.array(lists, pa.int32())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(c) for c in ("label", "width", "node", "vec", "copies")), pa.array(cell, pa.int32()), lists,
                            pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)
                        ],
                        names=["label", "width", "node", "vec", "copies", "cell", "probes", "code", "error"]
                    )

    return run


class ListPart:
    """A part of a list: its members, and what is known of their links.

    Of links, only counts and a spanning forest leave: (a, b, null) joins two nodes that links connect, (a, null, n)
    says that n more vectors are linked with a.
    """

    def __init__(self, index: Index, cell: int, first: bool, cosine: float):
        self.index, self.cell, self.first, self.cosine = index, cell, first, cosine
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.held, self.out = [], []

    def add(self, *columns) -> None:
        self.held.append(columns)

    def seal(self) -> None:
        """All members are there: they are compared with each other, by one task alone."""
        if self.held is None:
            return
        self.node, self.copies, self.raw, self.code, self.error = (np.concatenate(x) for x in zip(*self.held))
        self.size, self.held = np.sqrt((self.raw**2).sum(1)), None
        self.component, self.linked = np.arange(len(self.node)), np.zeros(len(self.node), np.int64)
        if self.first:
            self._meet(self.raw, self.node, self.copies, members=True)

    def query(self, node: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> None:
        self.seal()
        self._meet(raw, node, copies, members=False)

    def _meet(self, raw: np.ndarray, node: np.ndarray, copies: np.ndarray, members: bool) -> None:
        step = max(64, (1 << 20) // len(self.node))
        size = np.sqrt((raw**2).sum(1))
        for lo in range(0, len(raw), step):
            q = raw[lo : lo + step] / size[lo : lo + step, None]
            est = sum(t[:, self.code[:, m]] for m, t in enumerate(self.index.tables(q, self.cell)))
            near = est <= (self.reach + 1e-6 + self.error) ** 2
            if members:
                near &= np.arange(lo, lo + len(q))[:, None] < np.arange(len(self.node))
            x, y = np.nonzero(near)
            good = np.zeros(len(x), bool)
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)] + lo, y[k : k + (1 << 16)]
                good[k : k + (1 << 16)] = np.einsum("ij,ij->i", raw[a], self.raw[b]) / (size[a] * self.size[b]) >= self.cosine
            x, y = x[good] + lo, y[good]
            if not len(x):
                continue
            np.add.at(self.linked, y, copies[x])
            if members:
                np.add.at(self.linked, x, copies[y])
            edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
            for i, j in zip(edges, edges[1:]):
                hits = y[i:j]
                if not members:
                    self.out += [(int(node[x[i]]), int(self.node[hits[0]]), None), (int(node[x[i]]), None, int(self.copies[hits].sum()))]
                some = np.append(hits, x[i]) if members else hits
                parts = np.unique(self.component[some])
                for c in parts[1:]:
                    self.out.append((int(self.node[parts[0]]), int(self.node[c]), None))
                if len(parts) > 1:
                    self.component[np.isin(self.component, parts[1:])] = parts[0]

    def rows(self, done: bool = False) -> list:
        if done:
            self.seal()
            some = np.flatnonzero(self.linked)
            self.out += [(a, None, n) for a, n in zip(self.node[some].tolist(), self.linked[some].tolist())]
        out, self.out = self.out, []
        return out


def _search(blob, cosine: float):
    """Rows come ordered by (label, width, cell, part, salt) and members before queries; a part holds its members alone."""

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["a", "b", "n"])

    def run(batches):
        key, part = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("label", "width", "cell", "part", "salt"))))
            stops = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]] + [len(rows)] * bool(rows)
            node, copies, error, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "error", "query"))
            lo = 0
            for hi in stops:
                if rows[lo] != key:
                    if part is not None and (out := part.rows(True)):
                        yield batch_of(out)
                    key = rows[lo]
                    part = ListPart(blob.value[key[1]], key[2], key[4] == 0, cosine)
                raw = batch.column("vec").slice(lo, hi - lo).flatten().to_numpy().astype(float).reshape(hi - lo, key[1])
                n = int((~is_query[lo:hi]).sum())
                if n:
                    code = np.stack([np.frombuffer(x, np.uint8) for x in batch.column("code").slice(lo, n).to_pylist()])
                    part.add(node[lo : lo + n], copies[lo : lo + n], raw[:n], code, error[lo : lo + n])
                if n < hi - lo:
                    part.query(node[lo + n : hi], copies[lo + n : hi], raw[n:])
                lo = hi
            if part is not None and (out := part.rows()):
                yield batch_of(out)
        if part is not None and (out := part.rows(True)):
            yield batch_of(out)

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE
) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of vectors.

    Rows link when their labels are equal and not null, their vectors equally wide, and the cosine in double
    precision is at least `cosine`. Vectors that are null, empty, zero, or hold null or non-finite numbers link
    with nothing. Equal vectors of a label are one node of the search and count as links of each other.
    component_id is the smallest id of the component; kept: the id is that.

    The index is trained on at most SAMPLE vectors (those whose hashes are lowest) and holds every row. Pairs
    are dropped by table-lookup distances only where the residual's known coding error proves them too far, and
    lists only where SPREAD says that they hold nothing near; links found have the exact cosine.
    """
    v, kinds = F.col(vec_col), dict(vectors.dtypes)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(good, v).alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    nodes = cut(
        rows.where("node is not null").groupBy("node").agg(
            F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")
        ).withColumn("width", F.size("vec"))
    )
    # a row for each width of vectors: lists are as many as its largest label needs
    widths = nodes.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("width").agg(F.max("n").alias("n")).collect()
    indexes = {}
    for w in widths:
        sample = nodes.where(F.col("width") == w.width).orderBy("node").limit(SAMPLE).select("vec").collect()
        indexes[w.width] = Index(
            np.array([r.vec for r in sample], dtype=float), min(4096, max(1, w.n // PER_LIST), max(1, len(sample) // 4))
        )
    blob = vectors.sparkSession.sparkContext.broadcast(indexes)
    schema = f"label {kinds[label_col]}, width int, node long, vec {kinds[vec_col]}, copies long, cell int, probes array<int>, code binary, error double"
    coded = cut(map_arrow(nodes.select("label", "width", "node", "vec", "copies"), _assign(blob, cosine), schema))
    key = ["label", "width", "cell"]
    asked = coded.select("label", "width", F.explode("probes").alias("cell")).groupBy(*key).agg(F.count(F.lit(1)).alias("asked"))
    lists = coded.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(asked, key, "left")
    # a list of many queries deals them to several tasks, each with the list's members
    lists = cut(
        lists.select(
            *key, "parts", F.ceil(F.greatest(F.coalesce("asked", F.lit(0)), F.col("parts") * PART) / QUERIES).cast("int").alias("salts")
        )
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int")
    row = ["part", "salt", "query", "node", "copies", "vec", "code", "error"]
    known = coded.join(lists, key).withColumn("own", part)
    members = known.withColumns({"part": F.col("own"), "query": F.lit(False)}).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    ).select(*key, *row)
    others = known.where("own + 1 < parts").withColumns(
        {"part": F.explode(F.sequence(F.col("own") + 1, F.col("parts") - 1)), "salt": salt, "query": F.lit(True)}
    ).select(*key, *row)
    queries = coded.drop("cell").withColumn("cell", F.explode("probes")).join(lists, key)
    queries = queries.withColumns(
        {"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "salt": salt, "query": F.lit(True)}
    ).select(*key, *row)
    met = members.unionByName(others).unionByName(queries)
    met = met.repartition(*key, "part", "salt").sortWithinPartitions(*key, "part", "salt", "query")
    found_rows = cut(map_arrow(met, _search(blob, cosine), "a long, b long, n long"))

    links = found_rows.where("b is not null").select("a", "b")
    linked = found_rows.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = components(links)
    named = nodes.select("node", "first", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").join(linked, "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
