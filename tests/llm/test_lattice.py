import math
import zlib

import public_tokenizers
import pytest

from locuskit.llm.common import blank_words
from locuskit.llm.lattice import SMOOTHING, Lattice, first_scores, score_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(scores, word):
    """Every (log score, pieces); a character that is no piece counts as its bytes."""
    if not word:
        yield 0.0, ()
    for end in range(1, len(word) + 1):
        own = (word[:end],) if word[:end] in scores else () if end > 1 else tuple(
            f"<0x{b:02X}>" for b in word[0].encode())
        if own:
            for rest, pieces in segmentations(scores, word[end:]):
                yield sum(scores[p] for p in own) + rest, own + pieces


def all_ways(model, word):
    """Log probability by listing every segmentation."""
    return math.log(sum(math.exp(w) for w, _ in segmentations(model.scores, word)))


def test_forward_sums_all_segmentations():
    model = Lattice(first_scores(MODEL))
    for w in ("the", "there", "", "ça", "x二\U0001f9ea", "aaaa", "42nd,"):
        assert model.log_probability(w) == pytest.approx(all_ways(model, "▁" + w), rel=1e-12)
    assert model.log_probability("ab" * 5000) < -1000  # no underflow


def test_expected_pieces_cover_the_word():
    model, counts = Lattice(first_scores(MODEL)), {}
    model.expect("there", 3.0, counts)
    assert sum(len(p) * n for p, n in counts.items()) == pytest.approx(3 * 6)


WORDS = ["the", "there", "", "\u00e7a", "x\u4e8c\U0001f9ea", "aaaa", "42nd,", "a</s>b", "ab" * 60, "\u4e8c" * 5]


def test_many_words_at_once_equal_one_by_one():
    model = Lattice(first_scores(MODEL))
    assert model.log_probabilities(WORDS) == pytest.approx([model.log_probability(w) for w in WORDS], rel=1e-12)
    assert model.log_probabilities([]) == []
    one, all_ = {}, {}
    for i, w in enumerate(WORDS):
        model.expect(w, i + 1, one)
    model.expect_all(WORDS, list(range(1, len(WORDS) + 1)), all_)
    assert all_ == pytest.approx(one, rel=1e-9)


def test_long_words_in_bounded_memory():
    import tracemalloc
    model, counts, word = Lattice(first_scores(MODEL)), {}, "ab7q" * 50_000
    tracemalloc.start()
    model.expect(word, 1.0, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(word)  # two numbers a letter, not its arcs
    assert sum(len(p) * n for p, n in counts.items()) == pytest.approx(len(word) + 1, rel=1e-4)  # rounding of sums near -1e6


def test_scores_after_reweighting_against_every_segmentation(spark):
    docs = [(i, t) for i, t in enumerate(["there a b", "The cat, the \u4e8c", None, "", "42nd there"] * 3 + ["unseen x\u00e7"])]
    first = first_scores(MODEL)
    train = [w.decode() for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in blank_words(t)]
    found = {"</s>": float(sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs))}
    for w in train:
        ways = list(segmentations(first, "\u2581" + w))
        whole = sum(math.exp(x) for x, _ in ways)
        for x, pieces in ways:
            for p in pieces:
                found[p] = found.get(p, 0.0) + math.exp(x) / whole
    total = sum(found.values()) + SMOOTHING * len(first)
    scores = {p: math.log((found.get(p, 0.0) + SMOOTHING) / total) for p in first}
    model = Lattice(scores)
    want = {i: (sum(all_ways(model, "\u2581" + w.decode()) for w in blank_words(t)) + scores["</s>"]) / math.log(10)
            for i, t in docs}
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(docs, "doc_id int, text string"), MODEL).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("head", [2, 100])
def test_columns_against_brute_force(spark, head):
    docs = [(i, t) for i, t in enumerate(["a b a", "B c,", "the cat the cat", None, "", "a" * 300, "x y z"] * 3)]
    docs += [(None, "a b"), (1, "a b a"), (1, "a b a")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id int, text string, token string, c int")
    got = score_texts(df, MODEL, head=head).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    train = [w for i, t in docs if not held(i) for w in [*blank_words(t), None]]
    v = len(set(train))
    want = []
    for i, t in docs:
        words = [*blank_words(t), None]
        base = sum(math.log10((train.count(w) + 1) / (len(train) + v + 1)) for w in words)
        want.append((repr(i), held(i), len(words), sum(w in train for w in words), len(train), round(base, 9)))
    assert sorted((repr(r[0]), *r[1:5], round(r[5], 9)) for r in got) == sorted(want)
    by = {}
    for r, _ in zip(got, docs):
        by.setdefault((r["doc_id"], r["n_tokens"]), set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for (i, _), s in by.items() if i is not None)
    assert all(r["score"] < 0 for r in got)


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id int, text string"), MODEL).count() == 0
