"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder."""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The pattern by which byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are split and encoded at a time.
PIECE = 1 << 16
#: Bytes of a run that is merged one pair at a time.
SHORT = 128
#: Bytes that the remembered words and their ids may take, in each of two generations, and the longest such word.
REMEMBERED_BYTES, REMEMBERED_CHARS = 24 << 20, 64


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ids, merge ranks and the merge list's sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.lookahead = self._lookahead()
        #: For short runs: a pair's rank and result in one number.
        self.packed = {pair: r << 32 | new for pair, (r, new) in self.rank.items()}

    def _lookahead(self) -> int:
        """Bytes to the right of a token that can decide whether it takes part in a merge.

        A merge (x, y) needs y whole, and y can be lost only to an earlier merge (s, z) whose s ends y or is the
        right end of a part from which y is made. So in rank order: need(x, y) = len(y) + the most that any
        earlier merge with such an s on its left needs. The largest need suffices for the whole list.
        """
        size = {i: len(b) for i, b in self.bytes_of.items()}
        ends: dict[int, list[int]] = {i: [i] for i in self.id_of_byte}
        need: dict[int, int] = {}
        most = 1
        for (x, y), (_, xy) in self.rank.items():
            here = size[y] + max((need.get(s, 0) for s in ends.get(y, [y])), default=0)
            need[x] = max(need.get(x, 0), here)
            ends.setdefault(xy, [xy, *ends.get(y, [y])])
            most = max(most, here)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merge list to a run: the earliest merge first, from left to right."""
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """By a heap of the pairs and links between neighbours."""
        get, n = self.packed.get, len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            p, i, x, y = heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = p & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := get((ids[i], ids[k]))) is not None:
                    heappush(heap, (q, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (q := get((ids[h], ids[i]))) is not None:
                heappush(heap, (q, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """One merge at a time; only the pairs beside it are looked up anew."""
        get, none = self.packed.get, 1 << 62
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids


class Transducer:
    """Encodes one unsplit run of bytes that arrives piece by piece, in constant memory.

    It holds back as many bytes as the lookahead says; tokens that end before those are stable and leave.
    """

    def __init__(self, merges: Merges, hold: int | None = None):
        self.m, self.hold = merges, hold or max(2 * merges.lookahead, 64)
        self.tail = b""

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.hold
        if len(self.tail) + len(data) < self.m.lookahead + step:  # nothing is stable yet
            self.tail += data
            return
        for at in range(0, len(data), step):
            self.tail += data[at : at + step]
            if len(self.tail) >= self.m.lookahead + step:
                yield from self._emit(len(self.tail) - self.m.lookahead)

    def finish(self) -> Iterator[int]:
        """The tokens still held back; then the transducer is as new."""
        yield from self._emit(len(self.tail))

    def _emit(self, stable: int) -> Iterator[int]:
        end = 0
        for t in self.m.merge([self.m.id_of_byte[b] for b in self.tail]):
            n = len(self.m.bytes_of[t])
            if end + n > stable:
                break
            end += n
            yield t
        self.tail = self.tail[end:]


class _Remembered(dict):
    """Word -> its ids as bytes, by the transducer; two generations, each of at most REMEMBERED_BYTES."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.run, self.old, self.held = Transducer(merges), {}, 0

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            data = word.encode("utf-8", "surrogatepass")
            ids = array("I", [*self.run.feed(data), *self.run.finish()]).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            self.held += getsizeof(word) + getsizeof(ids) + 100  # and its place in the table
            if self.held > REMEMBERED_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Whole texts to ids and back, by the transducer."""

    def __init__(self, path: str):
        self.m = Merges(path)
        self.words = _Remembered(self.m)
        self.split = regex.compile(SPLIT)
        marks = sorted(self.m.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that split alone as they do in the whole: each but the first begins with a space after a character that isn't one."""
        at, n = 0, len(text)
        while n - at > PIECE:
            end = at + PIECE
            while end < n and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end
        if at < n:
            yield text[at:]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, piece by piece. Strings of special tokens give their ids."""
        text, at = text or "", 0
        marks = [(m.start(), m.end(), m[0]) for m in self.marks.finditer(text)] if self.marks else []
        for start, end, mark in [*marks, (len(text), len(text), None)]:
            for piece in self.pieces(text[at:start] if marks else text):
                yield b"".join(map(self.words.__getitem__, self.split.findall(piece)))
            if mark is not None:
                yield self.m.special[mark].to_bytes(4, "little")
            at = end


class Decoder:
    """Ids to text, incrementally: bytes of an unfinished character wait; bytes that can't begin or go on a character become U+FFFD. Unknown ids give nothing."""

    def __init__(self, merges: Merges):
        self.table = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        get = self.table.get
        return self.state.decode(b"".join([get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids array<int> (replaced if there); a null text counts as empty. path: the vocabulary file, on every machine."""
    keep = [f for f in docs.schema.fields if f.name != "token_ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", token_ids array<int>"

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(b"".join(c.encode(t)), dtype="<u4").astype(np.int32) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*(f.name for f in keep), "token_ids"]
            )

    return map_arrow(docs, run, schema)


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the decoded text; null ids give null."""
    keep = [f for f in rows.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out_col}` string"

    def run(batches):
        m = codec(path).m
        for batch in batches:
            texts = []
            for ids in batch.column(ids_col):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                d = Decoder(m)
                texts.append(d.feed(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) + d.finish())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), pa.array(texts, pa.string())], names=[*(f.name for f in keep), out_col]
            )

    return map_arrow(rows, run, schema)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, encoded and decoded piece by piece.

    One row for each input row, repeated rows included; null and empty texts have 0 tokens and the digests of
    nothing. No shuffle; ids and decoded text exist one piece at a time.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, coded, back = [], [], []
            for text in batch.column(1):
                ids_hash, text_hash, d, count = hashlib.sha256(), hashlib.sha256(), Decoder(c.m), 0
                for ids in c.encode(text.as_py()):
                    count += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(d.feed(ids).encode())
                text_hash.update(d.finish().encode())
                n.append(count)
                coded.append(ids_hash.hexdigest())
                back.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return map_arrow(
        docs.select(id_col, F.col(text_col).cast("string").alias("_text")), run,
        f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
