import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from folioflow.llm import token_files as TF
from folioflow.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [
    (5, "Hello, world! it's"), (3, None), (4, ""), (4, "twice"), (4, "twice"), (None, "no id"), (9, "ΑΣ İ \u2003 <|endoftext|>x ' ''s"),
    (10, "word " * 30000), (11, "x" * 3000)
]


@pytest.mark.parametrize("path, file_ids", [(PATH, TF.FILE_IDS), (PATH, 4), (vocabulary("byte_bpe_50k.json"), 1000)])
def test_round_trip(spark, path, file_ids):
    """One file a task, a file for nearly each document, and a vocabulary that the shortcut by words isn't for."""
    t = Tokenizer.from_file(path)
    assert TF.chunk_encoder(path).by_chunk == (path == PATH)
    d = spark.createDataFrame([(i, x, 1) for i, x in TEXTS], "doc_id long, text string, start long").repartition(3)
    folder = TF.token_folder(spark)
    got = sorted(TF.read_tokens(TF.write_tokens(d, path, folder, end_id=1, file_ids=file_ids), folder).collect(), key=lambda r: r.start)
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, x) in zip(got, rows, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_table(spark):
    folder = TF.token_folder(spark)
    d = spark.createDataFrame([], "doc_id long, text string")
    assert TF.read_tokens(TF.write_tokens(d, PATH, folder, end_id=1), folder).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 1000])
def test_file_gives_views(tmp_path, n):
    path = str(tmp_path / "f.arrows")
    ids = np.arange(n) % 50
    with pa.OSFile(path, "wb") as sink:
        w = TF.SequenceWriter(sink, pa.uint16(), length=4, rows=2)
        for part in np.array_split(ids, 3):
            w.add(part)
        w.close()
    f = TF.SequenceFile(fs.LocalFileSystem(), path)
    assert len(f) == -(-n // 4)
    if n:
        seq, mask = f.sequence(len(f) - 1)
        assert seq.base is not None and sum(mask.to_pylist()) == (n - 1) % 4 + 1
        assert f.slice(n // 3, n - n // 3).tolist() == ids[n // 3 :].tolist()


def test_small_memory_gives_the_same(monkeypatch):
    words = [f"{w}{p}".encode() for w in ("the", "The", "été", "a1", "ΑΣ") for p in ("", ",", "!!", "'s")]
    texts = [b" ".join(words[i:] + words[:i]) for i in range(len(words))]
    want = [x.tolist() for x in TF.ChunkEncoder(PATH).encode(texts)]
    monkeypatch.setattr(TF, "REMEMBERED", 5)
    c = TF.ChunkEncoder(PATH)
    assert [x.tolist() for t in texts for x in c.encode([t])] == want


def test_arrow_texts_as_the_library(monkeypatch):
    """Slices of Arrow arrays, a text at a time and together, with few words remembered: chunks of all kinds, white space of all kinds."""
    words = ["the", "The,", "THE...", "été!", "İx", "ΑΣ.", "don't", "'s", "a1b", "x" * 60, "é" * 60, "K", "\x1ca", "<|endoftext|>", "--", "naïve;", "日本語。", "ﬁ", "éa", "﻿", "\x00z"]
    gaps = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " ", " ", "\x85"]
    texts = [None, "", " ", "\n\n", *[g.join([*words[k:], *words[:k]]) for k, g in enumerate(gaps)], *[f" {w} " for w in words]]
    column = pa.array([None if x is None else x.encode() for x in ["left out", *texts, "left out"]], pa.binary()).slice(1, len(texts))
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for most in (TF.REMEMBERED, 3):
        monkeypatch.setattr(TF, "REMEMBERED", most)
        c = TF.ChunkEncoder(PATH)
        assert [x.tolist() for x in c.encode(column)] == want
        assert [x.tolist() for k in range(len(texts)) for x in c.encode(column.slice(k, 1))] == want
    assert list(c.encode(column.slice(0, 0))) == []
