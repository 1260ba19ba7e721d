"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own
from .shingles import SPACE, chunks, words

#: Buckets of hashed words; width of the interaction vectors; most labelled rows of the fit; score from which a document is good.
WORD_BUCKETS, RANK, SAMPLE, THRESHOLD = 1 << 15, 8, 6000, 0.3
EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
STATS = ("upper", "lower", "digit", "symbol", "high", "space", "distinct", "new_lines", "line_words", "word_bytes", "bytes", "n_chars")
_BINS = len(EDGES) + 1
DIM = WORD_BUCKETS + len(STATS) * (_BINS + 32)


def _classes() -> list[np.ndarray]:
    at = np.arange(256)
    upper, lower, digit = (at >= 65) & (at <= 90), (at >= 97) & (at <= 122), (at >= 48) & (at <= 57)
    high = at >= 128
    return [upper, lower, digit, ~(upper | lower | digit | high | SPACE), high, SPACE]


_CLASSES = _classes()


def features(texts: list[bytes | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value), ordered by text.

    Words: count over the length of the text's count vector. Statistics: shares and sizes of the text, one
    feature for each statistic and bin. Metadata: the table's n_chars, by powers of two; missing has its own.
    """
    h, before, _, _ = words(texts)
    n_words = np.diff(before)
    key = np.repeat(np.arange(len(texts)), n_words) * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    doc = key // WORD_BUCKETS
    norm = np.sqrt(np.bincount(doc, weights=count.astype(float) ** 2, minlength=len(texts)))
    docs, feats, vals = [doc], [key % WORD_BUCKETS], [count / norm[doc]]

    size = np.array([len(t or b"") for t in texts])
    seen = np.array([np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256) for t in texts]).reshape(len(texts), 256)
    share = [seen[:, c].sum(1) / np.maximum(size, 1) for c in _CLASSES]
    lines = [(t or b"").split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    share += [np.bincount(doc, minlength=len(texts)) / np.maximum(n_words, 1), np.array([len(set(x)) for x in lines]) / n_lines]
    log = lambda x: np.minimum(np.log2(np.maximum(x, 0) + 1).astype(np.int64), 30)
    bins = [np.searchsorted(EDGES, s) for s in share]
    bins += [
        log(n_words / n_lines), log(4 * size / np.maximum(n_words, 1)), log(size),
        np.where([c is None for c in n_chars], 31, log(np.array([c or 0 for c in n_chars], dtype=float)))
    ]
    for i, b in enumerate(bins):
        docs.append(np.arange(len(texts)))
        feats.append(WORD_BUCKETS + i * (_BINS + 32) + b)
        vals.append(np.full(len(texts), 0.5))
    docs, feats, vals = map(np.concatenate, (docs, feats, vals))
    order = np.argsort(docs, kind="stable")
    return docs[order], feats[order].astype(np.int64), vals[order]


class Machine:
    """score = sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the features."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(DIM), rng.normal(0, 0.02, (DIM, RANK))

    def parts(self, docs: np.ndarray, feats: np.ndarray, vals: np.ndarray, n: int):
        """docs must be ordered and name each of 0..n-1."""
        at = np.searchsorted(docs, np.arange(n))
        vx = self.v[feats] * vals[:, None]
        total = np.add.reduceat(vx, at)
        z = self.bias + np.add.reduceat(self.w[feats] * vals, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at)).sum(1)
        return z, total, vx

    def score(self, docs, feats, vals, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(docs, feats, vals, n)[0], -30, 30))) if n else np.zeros(0)

    def fit(
        self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, seed: int = 7
    ) -> Machine:
        """AdaGrad on log loss, both classes weighing alike up to the prior of 0.3 to 0.7; fixed order."""
        if not len(y):
            return self
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        weight = np.where(y == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
        gw, gv, gb, rng = np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6), 1e-6, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                batch = order[lo : lo + 64]
                docs = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                feats, vals = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
                z, total, vx = self.parts(docs, feats, vals, len(batch))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                gb += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(gb)
                each = err[docs] * vals
                ids, inverse = np.unique(feats, return_inverse=True)
                g = np.bincount(inverse, weights=each) + l2 * self.w[ids]
                gw[ids] += g**2
                self.w[ids] -= rate * g / np.sqrt(gw[ids])
                dv = each[:, None] * (total[docs] - vx)
                by = np.argsort(inverse, kind="stable")
                g = np.add.reduceat(dv[by], np.searchsorted(inverse[by], np.arange(len(ids)))) + l2 * self.v[ids]
                gv[ids] += g**2
                self.v[ids] -= rate * 0.5 * g / np.sqrt(gv[ids])
        return self

    def dump(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), bias=self.bias, w=self.w.astype(np.float32), v=self.v.astype(np.float32))
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Machine:
        m, got = Machine(), np.load(io.BytesIO(data))
        m.bias, m.w, m.v = float(got["bias"]), got["w"].astype(np.float64), got["v"].astype(np.float64)
        return m


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("_text"), _chars(docs).alias("_chars"), *more)


def _chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).try_cast("long")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    texts, chars = batch.column("_text").to_pylist(), batch.column("_chars").to_pylist()
    for lo, hi in chunks(texts):
        yield lo, hi, features(texts[lo:hi], chars[lo:hi])


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Machine:
    """Fits on at most `sample` labelled rows that aren't held out: those whose ids hash lowest, so always the same.

    Several labels of an id count by their mean; null ids and labels don't count. Without labels every score is 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~is_held_out(id_col))
    known = known.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # so many rows at most: its size is bounded

    def run(batches):
        for batch in batches:
            for lo, hi, (doc, feat, val) in _runs(batch):
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column("_label").slice(lo, hi - lo),
                        pa.array([feat[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]),
                        pa.array([val[at[i] : at[i + 1]].astype(np.float32).tobytes() for i in range(hi - lo)])
                    ],
                    names=["id", "label", "feats", "vals"]
                )

    kind = dict(docs.dtypes)[id_col]
    got = _texts(docs, id_col, text_col).join(F.broadcast(known), id_col).select(id_col, "_text", "_chars", "_label")
    rows = map_arrow(
        got, run, f"id {kind}, label int, feats binary, vals binary"
    ).orderBy(F.xxhash64("id"), "id", F.xxhash64("feats")).limit(sample).collect()
    seen = [(np.frombuffer(r.feats, np.int32).astype(np.int64), np.frombuffer(r.vals, np.float32).astype(float)) for r in rows]
    return Machine().fit(seen, np.array([r.label for r in rows], dtype=float))


def score_quality(
    docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on); columns of these names are replaced.

    Every row is scored over its whole text (a string or binary column), null as empty. The model goes to the executors as one blob of fixed size.
    """
    blob = docs.sparkSession.sparkContext.broadcast(model.dump())
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", score double, predicted int"
    names = [f.name for f in keep]

    size = own("_chars", docs)

    def run(batches):
        m = Machine.load(blob.value)
        for batch in batches:
            texts, chars = batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column(size).to_pylist()
            score = np.concatenate([np.zeros(0), *(m.score(*features(texts[lo:hi], chars[lo:hi]), hi - lo) for lo, hi in chunks(texts))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"]
            )

    return map_arrow(docs.select(*names, _chars(docs).alias(size)), run, schema)
