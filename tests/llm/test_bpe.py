import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from folioflow.llm import bpe
from folioflow.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LETTERS = "abcdehinorst é\n\t  '!?1234中😀\x1c\x85ſİ"


def texts():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    return [
        *out, "", None, "the" * 3000, " " * 2000, "a<|endoftext|> b<|endoftext|><|endoftext|>", " " * 70000 + "a" + " b" * 70000,
        "".join(rnd.choice("etaoin") for _ in range(6000))
    ]


def test_same_as_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = bpe.bpe_digests(d, PATH).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        ids = t.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(d.limit(0), PATH).count() == 0


def test_frames_round_trip(spark):
    d = spark.createDataFrame([(1, "héllo wörld", "x"), (2, None, None)], "doc_id long, text string, token_ids string")
    back = bpe.bpe_decode(bpe.bpe_encode(d, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["héllo wörld", ""] and back[1].token_ids == []


def test_lookahead_suffices():
    m = bpe.Merges(PATH)
    rnd = random.Random(4)
    for letters in ("ab", "etaoinshr", "in g", "-=", "0123"):
        data = "".join(rnd.choice(letters) for _ in range(2500)).replace(" ", "x").encode()
        whole = m.merge([m.id_of_byte[b] for b in data])
        for hold in (40, 700):
            run = bpe.Transducer(m, hold)
            parts = [t for i in range(0, len(data), 333) for t in run.feed(data[i : i + 333])]
            assert parts + list(run.finish()) == whole
            assert len(run.tail) == 0


def test_decoder_on_any_ids():
    t, m, rnd = Tokenizer.from_file(PATH), bpe.Merges(PATH), random.Random(5)
    for _ in range(300):
        ids, d = [rnd.randrange(50257) for _ in range(20)], bpe.Decoder(m)
        assert "".join(d.feed(np.array([i], "<u4").tobytes()) for i in ids) + d.finish() == t.decode(ids, skip_special_tokens=False)
