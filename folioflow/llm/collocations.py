"""Phrase collocation mining: exact counts of frequent phrases by hashed bucket counts and Apriori pruning, and their scores.

Pass k counts phrases of k words exactly, and beside that counts phrases of k + 1 words in hashed buckets. The next
pass then needs only those phrases whose bucket is full enough and whose first and last k words are frequent; both are
bitmaps of BUCKETS bits, broadcast. A bitmap may say yes too often, never no, so what passes is counted exactly and
nothing frequent is lost, however full the bitmaps are. A larger corpus wants more buckets (a byte each and task).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, cut, map_arrow, packed, remove, shared_dir
from .shingles import mix

LEAST, LONGEST, TOP, BUCKETS = 100, 5, 2000, 1 << 24
#: Bytes of text worked on at a time, rows of counts that a task holds, buckets in a row, and salts of the first ranking.
SEGMENT, HELD, CHUNK, SALTS = 2 << 20, 1 << 20, 1 << 16, 64

_GAP, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20241107)
_OF_BYTE, _OF_PLACE, _OF_SLOT = (_rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 256, LONGEST + 8))


class Words:
    """The words of a stretch of bytes: ids into `known`, the piece each stands in, and its hash."""

    def __init__(self, stretch: bytes):
        raw = _LOWER[np.frombuffer(stretch, np.uint8)]
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, end = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == _BREAK), self.start)
        offsets = np.concatenate([[0], np.cumsum(end - self.start)]).astype(np.int64)
        column = pa.Array.from_buffers(
            pa.large_string(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0])]
        ).dictionary_encode()
        self.ids, self.known = column.indices.to_numpy(), column.dictionary
        self.hash = self._hashes().take(self.ids)

    def _hashes(self) -> np.ndarray:
        _, offsets, data = self.known.buffers()
        if not len(self.known):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(offsets, np.int64)[: len(self.known) + 1]
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(_OF_BYTE[np.frombuffer(data, np.uint8)[: offsets[-1]]] * _OF_PLACE[place & 255], offsets[:-1]))

    def __len__(self) -> int:
        return len(self.ids)

    def buckets(self, k: int, seed: np.uint64, n: int) -> np.ndarray:
        """The bucket, of n, of the k words from each place on."""
        count = max(0, len(self) - k + 1)
        with np.errstate(over="ignore"):
            total = np.full(count, seed + np.uint64(k), np.uint64)
            for i in range(k):
                total += self.hash[i : i + count] * _OF_SLOT[i]
            return (mix(total) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each place on stand in one piece."""
        count = max(0, len(self) - k + 1)
        return self.piece[:count] == self.piece[k - 1 : k - 1 + count]

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """(the distinct phrases of k words that begin at the places, how often)."""
        key, base = self.ids[at].astype(np.int64), max(1, len(self.known))
        for i in range(1, k):
            _, key = np.unique(key * base + self.ids[at + i], return_inverse=True)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        parts = [self.known.take(pa.array(self.ids[at[first] + i])) for i in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]).cast(pa.string()), n


def stretches(texts: list[bytes]):
    """(words, how many of them were at the end of the stretch before) of stretches of SEGMENT bytes or little more.

    A stretch begins with the last words of the one before, so that every phrase lies whole in some stretch.
    """
    blob = b"\n".join(texts)
    at = end = carried = 0
    while end < len(blob):
        end = min(len(blob), end + SEGMENT)
        while end < len(blob) and not _KIND[blob[end]]:
            end += 1
        words = Words(blob[at:end])
        yield words, carried
        carried = min(LONGEST - 1, len(words))
        at = at + int(words.start[-carried]) if carried else end


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Counters:
    """Bucket counts that stop at `least`."""

    def __init__(self, n: int, least: int):
        self.least, self.n = least, np.zeros(n, np.min_scalar_type(least))

    def add(self, at: np.ndarray) -> None:
        at, n = np.unique(at, return_counts=True)
        self.n[at] = np.minimum(self.n[at] + n, self.least)

    def rows(self, empty: pa.Schema):
        for lo in range(0, len(self.n), CHUNK):
            part = self.n[lo : lo + CHUNK]
            if part.any():
                yield _row(empty, chunk=lo // CHUNK, counts=part.tobytes())


_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
_SQL_SCHEMA = "lang string, phrase string, f long, chunk int, counts binary"


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _by_lang(batches, column: str):
    """(lang, its texts in UTF-8) of each batch."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        ids, texts = langs.indices.to_numpy(), batch.column(column)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, [t.as_buffer().to_pybytes() for t in texts.take(pa.array(np.flatnonzero(ids == k)))]


def _merged(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    return pa.table({"lang": out["lang"], "phrase": out["phrase"], "f": out["f_sum"]})


def _counted_rows(table: pa.Table):
    for b in table.combine_chunks().to_batches(max_chunksize=1 << 16):
        n = len(b)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "phrase", "f")), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SCHEMA)


def _pass(k: int, longest: int, least: int, buckets: int, full, frequent):
    """Rows (lang, phrase, f): counts of phrases of k words that may be frequent, and of all words under the empty phrase in the first pass; rows (chunk, counts): bucket counts of phrases of k + 1 words."""

    def run(batches):
        counters = Counters(buckets, least) if k < longest else None
        held, rows = [], 0
        for lang, texts in _by_lang(batches, "text"):
            seed = seed_of(lang)
            for words, carried in stretches(texts):
                alive = words.whole(k)
                if k > 1:
                    part = _holds(frequent.value, words.buckets(k - 1, seed, buckets))
                    alive = alive & part[: len(alive)] & part[1 : len(alive) + 1]
                    alive[alive] = _holds(full.value, words.buckets(k, seed, buckets)[alive])
                at = np.flatnonzero(alive)
                phrases, n = words.counted(at[at + k > carried], k)
                if k == 1:
                    phrases = pa.concat_arrays([phrases, pa.array([""])])
                    n = np.append(n, n.sum())
                held.append(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "phrase": phrases, "f": pa.array(n, pa.int64())}))
                rows += len(n)
                if counters is not None:
                    both = words.whole(k + 1)
                    both &= alive[: len(both)] & alive[1 : len(both) + 1]
                    at = np.flatnonzero(both)
                    counters.add(words.buckets(k + 1, seed, buckets)[at[at + k + 1 > carried]])
                if rows >= HELD:
                    held = [_merged(held)]
                    rows = len(held[0])
                    if rows >= HELD // 2:
                        yield from _counted_rows(held[0])
                        held, rows = [], 0
        if held:
            yield from _counted_rows(_merged(held))
        if counters is not None:
            yield from counters.rows(_SCHEMA)

    return run


def _marked(k: int, least: int, buckets: int):
    """Bucket counts of `least` for each of the given phrases of k words."""

    def run(batches):
        counters = Counters(buckets, least)
        for lang, phrases in _by_lang(batches, "phrase"):
            for words, carried in stretches(phrases):
                at = np.flatnonzero(words.whole(k))
                counters.n[words.buckets(k, seed_of(lang), buckets)[at]] = least
        yield from counters.rows(_SCHEMA)

    return run


def _bitmap(rows: DataFrame, least: int, buckets: int):
    """A broadcast bitmap of the buckets whose counts in all rows (chunk, counts) reach least. buckets / 8 bytes pass through the driver."""
    kind = np.min_scalar_type(least)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                new = np.frombuffer(counts, kind)
                held[chunk] = np.minimum(held[chunk].astype(np.int64) + new, least).astype(kind) if chunk in held else new
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([np.packbits(n >= least).tobytes() for n in held.values()], pa.binary())],
                names=["chunk", "bits"]
            )

    summed = map_arrow(rows.where("chunk is not null").select("chunk", "counts").repartition("chunk"), run, "chunk int, bits binary")
    bits = np.zeros(max(1, buckets // 8), np.uint8)
    for r in summed.collect():  # a row a chunk
        lo = r["chunk"] * CHUNK // 8
        bits[lo : lo + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of every phrase of m words, up to `longest`, that occurs `least` times in its language; (lang, n) of all words).

    A-Z count as a-z; pieces end at . , ; : ! ? and 0x0A-0x0D, words at spaces and tabs; phrases lie in one piece of
    one text, and overlapping occurrences all count. Null and empty texts hold none; null languages are `und`. Rows
    that repeat count as often as they stand there. Each pass reads all texts once and shuffles what may be frequent.
    """
    assert 1 <= longest <= LONGEST and buckets >= 8 and buckets & (buckets - 1) == 0
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    base = packed(base.where("text is not null"), docs)
    folder = f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}"
    found, words, full, frequent = [], None, None, None
    for k in range(1, longest + 1):
        # written, as two things are read from it: texts are scanned once a pass
        map_arrow(base, _pass(k, longest, least, buckets, full, frequent), _SQL_SCHEMA).write.parquet(f"{folder}/{k}")
        raw = spark.read.schema(_SQL_SCHEMA).parquet(f"{folder}/{k}")
        counts = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        counts = cut(counts.where((F.col("f") >= least) | (F.col("phrase") == "")))
        if k == 1:
            words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
            counts = counts.where("phrase <> ''")
        found.append(counts.withColumn("m", F.lit(k)))
        for old in (full, frequent):
            if old is not None:
                old.unpersist()
        more = k < longest and not counts.isEmpty()
        if more:
            full = _bitmap(raw, least, buckets)
            frequent = _bitmap(map_arrow(counts.select("lang", "phrase"), _marked(k, least, buckets), _SQL_SCHEMA), least, buckets)
        remove(spark, f"{folder}/{k}")
        if not more:
            break
    remove(spark, folder)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("lang", "phrase", "m", "f"), words


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of up to 38 digits."""
    whole = lambda x, digits=17: x.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(F.lit(1000), 4) * whole(a) * whole(n), whole(left) * whole(right))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    buckets: int = BUCKETS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two words or more, by their lowest-scoring cut.

    a, l, r: occurrences of the phrase, of its words before the cut and of the others; n: all words of the language.
    Of cuts with the same score the first counts. A phrase goes where a longer frequent one holds it and occurs as
    often; it is enough to look one word further, as what lies between occurs as often, too. Ties in score go by a,
    then by the phrase's bytes. Nulls, empty texts and repeated rows are as in phrase_counts; an empty table gives an
    empty one, and other columns are left alone.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least, longest, buckets)
    counts = cut(counts)
    cand = counts.where("m > 1").withColumn("w", F.split("phrase", " "))
    ends = F.array(F.slice("w", F.lit(1), F.col("m") - 1), F.slice("w", F.lit(2), F.col("m") - 1))
    longer = cand.where("m > 2").select("lang", F.explode(F.transform(ends, lambda x: F.array_join(x, " "))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = cand.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < f").select("lang", "phrase", "m", "w", F.col("f").alias("a"))
    cuts = kept.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest")
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cut(cuts.select("lang", "phrase", "a", "k", "l", "r"))
    per = cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).join(words, "lang")
    scored = by_key(cuts, per, "lang", "rows").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    low = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    low = low.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # first among a salt's, then among what that leaves of a language: no task sorts all of a language
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = low.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
