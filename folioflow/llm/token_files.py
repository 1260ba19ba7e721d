"""Token files: Arrow streams of fixed-size-list batches of equal-length id sequences and masks."""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_dir

SEQUENCE, BATCH_ROWS = 2048, 64
#: Ids after which a task begins another file.
FILE_IDS = 1 << 27
#: The splitting for which a text's ids are those of its chunks. Any other goes to the library text by text.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed", "invert": True
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Words whose ids are remembered (of ASCII letters; of others and their chunks, runs between ASCII white space, in each of two generations); longest such.
REMEMBERED, REMEMBERED_BYTES = 400_000, 48


class _Recent:
    """A bounded map: when full, its entries become the old generation, from which those in use come back."""

    def __init__(self):
        self.now: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (v := self.now.get(key)) is None and (v := self.old.get(key)) is not None:
            self.now[key] = v
        return v

    def add(self, found: dict) -> None:
        if len(self.now) + len(found) > REMEMBERED:
            self.old, self.now = self.now, {}
        self.now.update(found if _short(found) else {k: v for k, v in found.items() if len(k) <= REMEMBERED_BYTES})


def _short(keys) -> bool:
    return max(map(len, keys), default=0) <= REMEMBERED_BYTES


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(ids), dtype="<u4"))


class ChunkEncoder:
    """Encodes by the tokenizers library, each distinct word once while it is remembered.

    Vocabularies that lower-case, drop white space, split letters from punctuation and end each word's last token
    with the word-end mark are known by SPLITTING: there a text's ids are those of its chunks between ASCII white
    space, and a chunk of letters with punctuation after it has the ids of the letters and then those of the
    punctuation. Every other chunk, and every text with another vocabulary, goes to the library as it is. Chunks of
    ASCII letters, which most are, are split, numbered and put together in Arrow; the others one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        self.size = self.t.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_chunk = all(
            spec.get(k) == v for k, v in SPLITTING.items()
        ) and spec["model"].get("end_of_word_suffix") == "</w>" and not any(
            m.isalpha() or len(m.split()) != 1 for m in marks
        )
        self.ends = np.zeros(self.size, bool)
        for token, i in self.t.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.chunks, self.words = _Recent(), _Recent()
        self.plain, self.plain_ids = pa.array([], pa.string()), _lists([])

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[str]) -> dict[str, bytes]:
        """Many words at a time; the word-end marks say where each ends."""
        out = {}
        for lo in range(0, len(new), 1000):
            some = new[lo : lo + 1000]
            ids = np.frombuffer(self._alone([" ".join(some)])[0], dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            out |= dict(zip(some, (data[x:y] for x, y in zip([0, *stops], stops)) if len(stops) == len(some) else self._alone(some)))
        return out

    def _plain(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of distinct words of small ASCII letters. When too many are remembered, only those that were asked for now stay."""
        place = pc.index_in(words, value_set=self.plain)
        new = words.filter(place.is_null())
        made = _lists(list(self._words(new.to_pylist()).values()))
        every = pa.concat_arrays([self.plain_ids, made])
        place = pc.fill_null(place, -1).to_numpy().copy()
        place[place < 0] = len(self.plain) + np.arange(len(new))
        out = every.take(pa.array(place))
        full = len(self.plain) + len(new) > REMEMBERED
        add, ids = (words, out) if full else (new, made)
        short = pc.less_equal(pc.binary_length(add), REMEMBERED_BYTES)
        held = [] if full else [self.plain], [] if full else [self.plain_ids]
        self.plain, self.plain_ids = pa.concat_arrays([*held[0], add.filter(short)]), pa.concat_arrays([*held[1], ids.filter(short)])
        return out

    def _others(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks of any kind."""
        known = list(map(self.chunks.get, chunks))
        fresh = [c for c, x in zip(chunks, known) if x is None]
        # decoded and lower-cased together; the line feeds between them are in none, as they are white space
        whole = b"\n".join(fresh).decode("utf-8", "surrogatepass") if fresh else ""
        low = whole.lower().split("\n")
        parts: dict[bytes, tuple[str, str]] = {}
        rest, wanted = [], set()
        for c, text, x in zip(fresh, whole.split("\n"), low):
            word, bare = text.rstrip(string.punctuation), x.rstrip(string.punctuation)
            if word.isalpha() and bare.isalpha() and "\u03a3" not in word:  # whose lower case would depend on its place
                parts[c] = bare, text[len(word) :]
            else:
                rest.append(c)
        for x in parts.values():
            wanted.update(x)
        wanted.discard("")
        held = {x: ids for x in wanted if (ids := self.words.get(x)) is not None}
        wanted = [x for x in wanted if x not in held]
        marks = [x for x in wanted if not x.isalpha()]
        made = self._words([x for x in wanted if x.isalpha()]) | dict(zip(marks, self._alone(marks)))
        self.words.add(made)
        held |= made
        held[""] = b""
        found = {c: held[w] + held[m] for c, (w, m) in parts.items()}
        found |= dict(zip(rest, self._alone([c.decode("utf-8", "surrogatepass") for c in rest])))
        self.chunks.add(found)
        return [found[c] if x is None else x for c, x in zip(chunks, known)]

    def _chunks(self, chunks: pa.Array) -> pa.LargeListArray:
        """The ids of distinct chunks: those of a word and of the marks after it, or of one that isn't plain and of nothing."""
        word = pc.ascii_rtrim(chunks, characters=string.punctuation)
        plain = pc.ascii_is_alpha(word)
        bare = pc.ascii_lower(word.filter(plain)).dictionary_encode()
        marks = pc.ascii_ltrim(chunks.filter(plain), characters=string.ascii_letters).dictionary_encode()
        other = chunks.filter(pc.invert(plain)).cast(pa.binary()).to_pylist()
        tails = marks.dictionary.cast(pa.binary()).to_pylist()
        words, rest = self._plain(bare.dictionary), _lists([*self._others(tails), *self._others(other), b""])
        pieces, is_plain = pa.concat_arrays([words, rest]), plain.to_numpy(zero_copy_only=False)
        pair = np.full((len(chunks), 2), len(pieces) - 1)
        pair[is_plain, 0], pair[is_plain, 1] = bare.indices.to_numpy(), len(words) + marks.indices.to_numpy()
        pair[~is_plain, 0] = len(words) + len(tails) + np.arange(len(other))
        both = pieces.take(pa.array(pair.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets.to_numpy()[::2], both.values)

    def encode(self, texts: pa.Array | list[bytes | None]) -> Iterator[np.ndarray]:
        texts = pc.fill_null(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts.cast(pa.binary()), b"")
        if not self.by_chunk:
            yield from (np.frombuffer(x, dtype="<u4") for x in self._alone([t.decode("utf-8", "surrogatepass") for t in texts.to_pylist()]))
            return
        split = pc.ascii_split_whitespace(texts.view(pa.string()))  # these functions look at single bytes
        coded = split.flatten().dictionary_encode()
        every = self._chunks(coded.dictionary).take(coded.indices)
        first = split.offsets.to_numpy()
        ids, stops = every.values.to_numpy(), every.offsets.to_numpy()[first - first[0]].tolist()
        yield from (ids[x:y] for x, y in zip(stops, stops[1:]))


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs ids end to end into sequences of `length`; the last one is padded and masked there."""

    def __init__(self, sink, kind: pa.DataType, length: int = SEQUENCE, rows: int = BATCH_ROWS):
        self.kind, self.length, self.rows = kind, length, rows
        self.out = pa.ipc.new_stream(sink, _schema(kind, length))
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n += len(ids)
        full = self.length * self.rows
        if self.n >= full:
            flat = np.concatenate(self.held)
            at = 0
            for at in range(0, len(flat) - full + 1, full):
                self._write(flat[at : at + full], full)
            rest = flat[at + full :]
            self.held, self.n = [rest], len(rest)

    def _write(self, flat: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < real)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=_schema(self.kind, self.length)))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.concatenate([flat, np.zeros(-len(flat) % self.length, flat.dtype)]), len(flat))
        self.out.close()


class SequenceFile:
    """Random access to a token file: a local file is mapped, and nothing is copied until numbers are asked for."""

    def __init__(self, files: fs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else SEQUENCE
        self.rows = len(self.batches[0]) if self.batches else BATCH_ROWS

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence's ids, a view of the file, and its mask."""
        b, k = self.batches[i // self.rows], i % self.rows
        return self._flat(b)[k * self.length : (k + 1) * self.length], b.column("mask")[k].values

    def _flat(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").values.to_numpy(zero_copy_only=True)

    def slice(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on, counted without padding."""
        full, parts = self.length * self.rows, []
        while n > 0:
            got = self._flat(self.batches[start // full])[start % full : start % full + n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


class TokenFile:
    """A pair of files that a task writes: sequences, and an index of (id, start in the file, number of ids)."""

    def __init__(self, folder: str, width: pa.DataType, length: int, id_type: pa.DataType):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        self.path, self.at = f"{base}/{uuid.uuid4().hex}", 0
        self.sinks = [files.open_output_stream(self.path + x) for x in (".arrows", ".index.arrows")]
        self.writer = SequenceWriter(self.sinks[0], width, length)
        self.schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_stream(self.sinks[1], self.schema)

    def add(self, ids: pa.Array, texts: list[np.ndarray]) -> None:
        counts = np.array([len(x) for x in texts], dtype=np.int64)
        for x in texts:
            self.writer.add(x)
        starts = self.at + np.cumsum(counts) - counts
        self.at += int(counts.sum())
        self.index.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts)], schema=self.schema))

    def close(self) -> None:
        self.writer.close()
        self.index.close()
        for s in self.sinks:
            s.close()


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    length: int = SEQUENCE, file_ids: int = FILE_IDS
) -> DataFrame:
    """Writes the ids of all texts in ascending order of id (nulls first, equal ids by text) and returns the manifest.

    folder: a URI that every machine reaches. One range of ids is one task, which begins another pair of files after
    every file_ids ids; a document is never split. Names are unique to the attempt and only the manifest names the
    files that count, so a lost or repeated task leaves no wrong file in use. Null and empty texts have the end id
    alone. The manifest: part, file, path, n_tokens; (part, file) ascend with the ids.
    """
    ordered = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")
    ).repartitionByRange("id").sortWithinPartitions("id", "t")

    def run(batches):
        coder, out, number = chunk_encoder(vocabulary), None, 0
        width = pa.uint16() if max(coder.size, (end_id or 0) + 1) <= 1 << 16 else pa.uint32()
        end = np.array([] if end_id is None else [end_id], dtype="<u4")
        part = TaskContext.get().partitionId()
        row = lambda f, k: pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([f.path]), pa.array([f.at], pa.int64())],
            names=["part", "file", "path", "n_tokens"]
        )
        for batch in batches:
            coded = coder.encode(batch.column("t"))
            for lo in range(0, len(batch), 256):
                some = batch.column("id").slice(lo, 256)
                if out is None:
                    out = TokenFile(folder, width, length, some.type)
                out.add(some, [np.concatenate([ids, end]) for ids in islice(coded, len(some))])
                if out.at >= file_ids:
                    out.close()
                    yield row(out, number)
                    out, number = None, number + 1
        if out is not None:
            out.close()
            yield row(out, number)

    return cut(map_arrow(ordered, run, "part int, file int, path string, n_tokens long"))


def read_tokens(manifest: DataFrame, folder: str, kind: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts the ids of all documents before it."""
    before = W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # a row a file

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                files, _ = fs.FileSystem.from_uri(folder)
                ids = SequenceFile(files, path + ".arrows")
                with files.open_input_stream(path + ".index.arrows") as f:
                    for index in pa.ipc.open_stream(f):
                        starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(ids.slice(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [index.column("id"), pa.array(starts + base), pa.array(counts), pa.array(crc, pa.int64())],
                            names=[id_col, "start", "n_tokens", "ids_crc32"]
                        )

    return map_arrow(
        manifest.join(F.broadcast(bases), ["part", "file"]).select("path", "base"), run,
        f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long"
    )


def token_folder(spark) -> str:
    """A new folder for token files in the shared folder."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
