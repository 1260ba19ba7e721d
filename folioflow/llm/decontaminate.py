"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

A first pass counts the documents that hold each gram of the benchmark. Each item's rarer half of grams are its seeds;
a seed weighs log(1 + documents / documents that hold it). A second pass finds the seeds, which join passages to items.
Rarity is relative to the item: one that leaked into a third of all documents has frequent grams only and keeps seeds.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own
from .shingles import chunks, windows, words

#: Words of a seed; least alignment score as a share of the item's words; text bytes of the items of one pass.
GRAM, SCORE, PASS_BYTES = 3, 0.5, 8 << 20
#: Weight of seeds that a passage needs, and the share of its item's whole weight that suffices.
WEIGHT, WEIGHT_SHARE = 5.0, 0.2
#: Seeds that an item has at least, if it has as many grams.
LEAST_SEEDS = 16
_PUNCTUATION = string.punctuation.encode()


def plain(text: bytes | None) -> bytes:
    """The text without ASCII punctuation."""
    return (text or b"").translate(None, _PUNCTUATION)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences and where it ends in b: match 1, mismatch and gap -1."""
    best, end, row, at = 0, 0, np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for x in a:
        step = np.maximum(row - 1, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(b == x, 1, -1))
        row = np.maximum.accumulate(step + at) - at  # gaps within the row
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def gram_numbers(grams: np.ndarray, seen: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in g, number of the gram there) of the sorted grams; seen: a bit for each value of their last 20 bits."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(seen[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
    k = np.minimum(np.searchsorted(grams, g[at]), len(grams) - 1)
    hit = grams[k] == g[at]
    return at[hit], k[hit]


def _seen(grams: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return seen


class Items:
    """One pass's benchmark items: their words, and the distinct grams of all and of each."""

    def __init__(self, texts: list[bytes | None], gram: int):
        h, before, _, _ = words([plain(t) for t in texts])
        self.words = [h[before[i] : before[i + 1]] for i in range(len(texts))]
        g, at = windows(h, before, gram)
        self.grams, number = np.unique(g, return_inverse=True)
        self.of_item = [np.unique(number[at[i] : at[i + 1]]) for i in range(len(texts))]
        self.seen = _seen(self.grams)


class Seeds:
    """The rarest grams of each item, the items of each, and what a passage needs of their weight.

    count: how many documents hold each gram. Those of an item's grams that any holds are ordered by that; the rarer
    half are its seeds, and at least LEAST_SEEDS. So a phrase that many items or documents share is a seed of those items only that have
    little else, and an item that leaked everywhere keeps its seeds.
    """

    def __init__(self, items: Items, count: np.ndarray, documents: int):
        weight = np.log1p(documents / np.maximum(count, 1))
        chosen = []
        for grams in items.of_item:
            order = grams[np.lexsort((items.grams[grams], count[grams]))]
            order = order[count[order] > 0]
            chosen.append(order[: max(LEAST_SEEDS, -(-len(order) // 2))])
        number = np.concatenate([np.zeros(0, np.int64), *chosen])
        owner = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
        order = np.argsort(number, kind="stable")
        used, at = np.unique(number[order], return_index=True)
        self.grams, self.weight = items.grams[used], weight[used]
        self.owner, self.first = owner[order], np.concatenate([at, [len(number)]])
        self.n_seeds = np.array([len(x) for x in chosen])
        self.need = np.array([min(WEIGHT, WEIGHT_SHARE * weight[x].sum()) for x in chosen])
        self.size = np.array([len(w) for w in items.words])
        self.seen = _seen(self.grams)

    def passages(self, at: np.ndarray, number: np.ndarray, n_words: int, gram: int):
        """(item, first word, end) of the stretches in which enough seeds of an item stand; at, number: the seeds in a text."""
        reps = np.diff(self.first)[number]
        within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        owner = self.owner[np.repeat(self.first[number], reps) + within]
        place, number = np.repeat(at, reps), np.repeat(number, reps)
        order = np.lexsort((place, owner))
        place, number, owner = place[order], number[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(place) > self.size[owner[1:]] + 10)]))
        for lo, hi in zip(new, [*new[1:], len(owner)]):
            item, k = owner[lo], np.unique(number[lo:hi])
            if len(k) >= min(2, self.n_seeds[item]) and self.weight[k].sum() >= self.need[item] - 1e-9:
                yield int(item), max(0, int(place[lo]) - self.size[item]), min(n_words, int(place[hi - 1]) + gram + self.size[item])


def _count(blob, gram: int):
    """(gram, n): how many of a batch's texts hold each of the items' grams; at their number, how many texts there are."""

    def run(batches):
        items: Items = blob.value
        for batch in batches:
            texts, count = batch.column("t").to_pylist(), np.zeros(len(items.grams), np.int64)
            for lo, hi in chunks(texts):
                h, before, _, _ = words([plain(t) for t in texts[lo:hi]])
                g, at = windows(h, before, gram)
                where, number = gram_numbers(items.grams, items.seen, g)
                text = np.searchsorted(at, where, side="right") - 1
                count += np.bincount(np.unique(text * len(items.grams) + number) % max(1, len(items.grams)), minlength=len(items.grams))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(held, len(count)), pa.int32()), pa.array(np.append(count[held], len(texts)), pa.int64())],
                names=["gram", "n"]
            )

    return run


def _scan(blob, gram: int):
    """Candidate passages of each text: the item, the first word, and the words' hashes."""

    def run(batches):
        seeds: Seeds = blob.value
        for batch in batches:
            texts, rows = batch.column("t").to_pylist(), []
            for lo, hi in chunks(texts):
                h, before, _, _ = words([plain(t) for t in texts[lo:hi]])
                g, at = windows(h, before, gram)
                where, number = gram_numbers(seeds.grams, seeds.seen, g)
                cut_at = np.searchsorted(where, at)
                for i in np.flatnonzero(np.diff(cut_at)):
                    here = slice(cut_at[i], cut_at[i + 1])
                    for item, start, end in seeds.passages(where[here] - at[i], number[here], int(before[i + 1] - before[i]), gram):
                        rows.append((lo + i, item, start, h[before[i] + start : before[i] + end].tobytes()))
            if rows:
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("version").take(take), pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())
                    ],
                    names=["id", "version", "item", "start", "passage"]
                )

    return run


def _align(blob, score: float):
    def run(batches):
        items: Items = blob.value
        for batch in batches:
            keep, out = [], {"score": [], "start": [], "n_words": []}
            rows = zip(*(batch.column(c).to_pylist() for c in ("item", "start", "passage")))
            for i, (item, start, passage) in enumerate(rows):
                a, b = items.words[item], np.frombuffer(passage, np.uint64)
                best, end = align(a, b)
                if best >= score * len(a):
                    begin = end - align(a[::-1], b[:end][::-1])[1]
                    keep.append(i)
                    out["score"].append(best / len(a))
                    out["start"].append(start + begin)
                    out["n_words"].append(end - begin)
            if keep:
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(take) for c in ("id", "version", "item")), pa.array(out["score"], pa.float64()),
                        pa.array(out["start"], pa.int64()), pa.array(out["n_words"], pa.int64())
                    ],
                    names=["id", "version", "item", "score", "start_word", "n_words"]
                )

    return run


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str, text_col: str, score: float) -> DataFrame:
    """(id, version, item_id, score, start_word, n_words) of the passages that align; version: a hash of the text."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"),
        F.col(text_col).cast("string").cast("binary").alias("t")
    )
    tests = benchmark.select(
        F.col(item_col).alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("t")
    ).where("t is not null").distinct()
    total = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-total // PASS_BYTES))
    types, out = (dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]), None
    for i in range(passes):
        some = tests.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(passes)) == i).orderBy("item_id", "t").collect()  # PASS_BYTES or so
        items = Items([bytes(r.t) for r in some], GRAM)
        blob = spark.sparkContext.broadcast(items)
        got = map_arrow(  # two numbers for each gram of the pass
            base.select("t"), _count(blob, GRAM), "gram int, n long"
        ).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(len(items.grams) + 1, np.int64)
        count[got.column("gram").to_numpy()] = got.column("n").to_numpy()
        seeds = spark.sparkContext.broadcast(Seeds(items, count[:-1], int(count[-1])))
        passages = map_arrow(base, _scan(seeds, GRAM), f"id {types[0]}, version long, item int, start int, passage binary")
        found = map_arrow(
            passages.repartition(F.xxhash64("id", "version", "item", "start")), _align(blob, score),
            f"id {types[0]}, version long, item int, score double, start_word long, n_words long"
        )
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(some)], f"item int, item_id {types[1]}")
        found = found.join(F.broadcast(names), "item").drop("item")  # the items of a pass
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", score: float = SCORE
) -> DataFrame:
    """(id, item, score, start_word, n_words): each pair of a document and an item of which it holds a copy or an edited copy.

    Words are compared without ASCII punctuation, A-Z as a-z. A passage is aligned with an item when it holds two
    of the item's seeds (one where it has no more) of enough weight together; the pair is returned when the best
    local alignment reaches `score` of the item's words. Null texts and texts without words match nothing, and
    nothing matches empty items; an item of fewer words than a seed is found where it is the whole text. Of several passages of an id the best counts. Rows that repeat give one row. Rows
    with a null id are judged, too.

    The items go out in passes of PASS_BYTES, so what is broadcast is bounded at any size of the benchmark;
    documents are read twice a pass (to count grams, and for seeds) and their texts are never shuffled.
    """
    found = _found(docs, benchmark, id_col, item_col, text_col, score)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("s"), "n_words")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"),
        F.col("b.n_words").alias("n_words")
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", score: float = SCORE
) -> DataFrame:
    """docs without contaminated ones. A row that shares only its id with one stays; so do null and empty texts."""
    key, version = own("_id", docs), own("_version", docs)
    bad = _found(docs, benchmark, id_col, item_col, text_col, score).select(
        F.col("id").alias(key), F.col("version").alias(version)
    ).distinct()
    return docs.join(
        bad.hint("shuffle_hash"), docs[id_col].eqNullSafe(bad[key]) & (F.xxhash64(docs[text_col].cast("string")) == bad[version]),
        "left_anti"
    )
