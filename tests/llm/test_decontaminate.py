import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locuskit.llm.common import alnum_words
from locuskit.llm.decontaminate import contamination, winnow

DOCS = "doc_id bigint, text string, n_hit string, norm int"
ITEMS = "item_id bigint, text string, cls string"


def brute(docs, items, window):
    out = []
    for i, t in docs:
        words, hit, ids = alnum_words(t), set(), set()
        for k, it in items:
            iw = alnum_words(it)
            n = min(window, len(iw))
            if k is None or not n:
                continue
            grams = {tuple(iw[a:a + n]) for a in range(len(iw) - n + 1)}
            for a in range(len(words) - n + 1):
                if tuple(words[a:a + n]) in grams:
                    hit |= set(range(a, a + n))
                    ids.add(str(k))
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sieve", [1000, 0])
def test_equals_brute_force(spark, sieve):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")  # noqa: E731  few words: many ties, repeats and overlaps
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 6, 9, 12])))) for k in range(12)]
    items += [(3, items[5][1]), (10, items[5][1].upper()), (None, "a b c"), (20, None), (21, "..")]
    docs = [(k % 7 if k % 5 else None, "-".join(word() for _ in range(rng.choice([0, 1, 5, 40, 400])))) for k in range(40)]
    docs += [(1, None), (2, ""), docs[3], (9, "x " * 3000 + (items[5][1] or ""))]
    got = contamination(spark.createDataFrame([(i, t, "c", 1) for i, t in docs], DOCS),
                        spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS), gram=3, window=6, sieve=sieve)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 6)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(none, items).count() == 0
    one = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    assert [r["contaminated"] for r in contamination(one, items).collect()] == [False]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 8))
def test_every_window_has_a_fingerprint(values, width):
    spots = winnow(np.array(values, np.uint64), width)
    for a in range(len(values) - width + 1):
        assert ((spots >= a) & (spots < a + width)).any()
