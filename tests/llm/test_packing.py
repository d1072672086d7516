import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locuskit.llm.packing import Encoder, pack, places, plan_packs

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length string, sequence_id int"


def whole(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_word_cache_equals_whole_texts(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["a b\x1c ć ́d it's 'll x\t\n", "", "<|endoftext|> x", "ΣΑΣ Σ ß İ", "  a \u0085b"]
    enc = Encoder(PATH)
    for t in texts:
        assert enc.ids(t) == whole(t)[:-1].tobytes()


def check(rows, docs, size):
    held, by_doc = {}, {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    got = sorted((r["doc_id"] or -1, r["start"], r["ids_crc32"], r["length"], r["doc_tokens"]) for r in rows)
    want = []
    for i, t in docs:
        ids = whole(t)
        want += [(i or -1, a, zlib.crc32(ids[a:a + size].tobytes()), len(ids[a:a + size]), len(ids))
                 for a in range(0, len(ids), size)]
    assert got == sorted(want)


def test_round_trip_with_nulls_copies_and_long_texts(spark):
    docs = [(1, "one two three"), (1, "one two three"), (None, None), (None, "x " * 70), (4, ""), (5, "y " * 41),
            (6, " "), (7, "z"), (8, "w " * 15)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], SCHEMA)
    check(pack(df, PATH, size=16).collect(), docs, 16)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=20))
def test_every_piece_has_one_place(histogram):
    patterns = plan_packs(histogram, 32)
    assert all(sum(n * t for n, t in parts) <= 32 for _, parts in patterns)
    assert len(patterns) <= 2 * len(histogram)
    for length, n in histogram.items():
        assert sum(packs * t for packs, parts in patterns for ln, t in parts if ln == length) == n
    where = places(patterns)
    for length, n in histogram.items():
        mine = where["length"] == length
        lows = where["low"][mine]
        assert len(lows) and lows[0] == 0 and (np.diff(lows) > 0).all() and lows[-1] < n


def test_little_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(df, PATH).collect()
    n = 1 + max(r["sequence_id"] for r in rows)
    assert sum(r["length"] for r in rows) > 0.95 * 2048 * (n - 1)
