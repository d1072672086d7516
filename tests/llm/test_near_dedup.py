import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, prepare, sieved
from locuskit.llm.components import components
from locuskit.llm.crowds import crowd_links
from locuskit.llm.near_dedup import near_duplicates

SCHEMA = "doc_id bigint, text string, cls string, node int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], SCHEMA)


def grams(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def top(root, i):
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def linked(sets, num=85, den=100):
    """Pairs (i, j) of similar sets, every pair that shares an element counted."""
    index, out = {}, []
    for i, s in enumerate(sets):
        shared = np.zeros(i, np.int32)
        for g in s:
            for j in index.get(g, ()):
                shared[j] += 1
            index.setdefault(g, []).append(i)
        out += [(int(j), i) for j in np.flatnonzero(shared)
                if den * shared[j] >= num * (len(s) + len(sets[j]) - shared[j])]
    return out


def brute(docs, **more):
    """One set per distinct text content; equal sets are one class."""
    sets = [grams(t) for _, t in docs]
    distinct = sorted(set(sets), key=lambda s: sorted(s))
    at = {s: n for n, s in enumerate(distinct)}
    root = list(range(len(distinct)))
    for i, j in linked(distinct, **more):
        a, b = top(root, i), top(root, j)
        root[max(a, b)] = min(a, b)
    least = {}
    for (i, _), s in zip(docs, sets):
        if s and i is not None:
            c = top(root, at[s])
            least[c] = min(i, least.get(c, i))
    out = []
    for (i, _), s in zip(docs, sets):
        c = least.get(top(root, at[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def changed(words, rng, n, tag):
    """``n`` words replaced by new ones, far apart."""
    out, step = list(words), len(words) // (n + 1)
    for j in range(n):
        out[step * (j + 1) - rng.randrange(step // 3 + 1)] = f"{tag}q{j}"
    return out


def crowd(rng, n, outer, words=300, edits=4):
    """``n`` copies that differ in a word each, and ``outer`` texts similar to just one of them."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    inner = []
    for i in range(n):
        at, ws = 10 + i % (words - 20), list(base)
        ws[at] = f"c{i}"
        inner.append((at, ws))
    docs = [" ".join(ws) for _, ws in inner]
    for i in range(outer):
        at, ws = inner[(i * 7) % n]
        ws = list(ws)
        for j in range(edits):  # away from the word that tells the copy from the others
            ws[(at + 30 + j * 60) % (words - 10) + 5] = f"o{i}x{j}"
        docs.append(" ".join(ws))
    return docs


def test_edge_rows(spark):
    a = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, a), (5, a), (5, a.upper()), (6, a + " tail"), (7, "one two"),
            (7, "ONE  two"), (8, "one two three"), (9, "é è"), (None, None), (10, "x y z u v"), (11, "x y z u v")]
    assert got(near_duplicates(frame(spark, docs))) == brute(docs)
    lone = [(None, a), (None, a)]
    assert got(near_duplicates(frame(spark, lone))) == [(None, 56, None, True)] * 2
    assert got(near_duplicates(frame(spark, []))) == []


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join(changed(words, rng, 900, "z"))), (3, " ".join(reversed(words)))]
    assert got(near_duplicates(frame(spark, docs))) == brute(docs)


@pytest.mark.parametrize("n", [300, 600, 3000])
def test_single_links_into_large_groups(spark, n):
    """At least 0.9 of the links that alone join a text to a group of near copies are found."""
    rng = random.Random(n)
    docs = list(enumerate(crowd(rng, n, 60) + [" ".join(f"u{i}_{j}" for j in range(40)) for i in range(50)]))
    found = {r[0]: r[2] for r in got(near_duplicates(frame(spark, docs)))}
    sets = [grams(t) for _, t in docs]
    truth = {}
    if n <= 600:
        truth = {r[0]: r[2] for r in brute(docs)}
        assert all(truth[i] == 0 for i in range(n + 60))
    assert all(found[i] == 0 for i in range(n))
    outer = [i for i in range(n, n + 60)]
    for i in outer:  # each is similar to its own copy and to no other of the first ones
        own = (i - n) * 7 % n
        share = lambda j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert share(own) >= 0.85 > max(share(j) for j in range(0, n, 13) if j != own)
    assert sum(found[i] == 0 for i in outer) >= 54
    assert all(found[i] == i for i in range(n + 60, len(docs)))


def test_isolated_pairs_at_the_threshold(spark):
    rng = random.Random(9)
    docs = []
    for p in range(300):
        words = [f"p{p}_{rng.randrange(10_000)}" for _ in range(500)]
        docs += [" ".join(words), " ".join(changed(words, rng, 7, f"e{p}"))]
    found = [r[2] for r in sorted(got(near_duplicates(frame(spark, list(enumerate(docs))))), key=lambda r: r[0])]
    want = {i for i, _ in linked([grams(t) for t in docs])}
    assert len(want) == 300
    assert sum(found[i + 1] == i for i in want) >= 270


def test_crowd_links_are_exact(spark):
    """Drawn sets around a few centres, at mixed distances, against all pairs."""
    rng = random.Random(4)
    sets = []
    for c in range(3):
        centre = [c * 100_000 + v for v in range(200)]
        variant = centre[:150] + [c * 100_000 + 50_000 + v for v in range(50)]
        for i in range(90):
            kept = [v for v in (centre if i % 3 else variant) if rng.random() > rng.choice([0.01, 0.04, 0.08])]
            sets.append(frozenset(kept + [c * 100_000 + 90_000 + rng.randrange(60) for _ in range(rng.randrange(18))]))
    name = lambda i: i.to_bytes(4, "big")
    rows = [(bytearray(name(i)), bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "cls binary, values binary")
    members = held.select(F.lit(5).cast("bigint").alias("crowd"), "cls").unionByName(
        held.select(F.lit(6).cast("bigint").alias("crowd"), "cls").limit(100))
    scratch = Scratch(prepare(spark), "t")
    links = scratch.store(crowd_links(members, held, 85, 100, scratch), "all")
    pairs = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in links.collect()]
    for i, j in pairs:  # nothing is linked that is not similar
        assert 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    root, want = list(range(len(sets))), list(range(len(sets)))
    for r, found in ((root, pairs), (want, linked(sets))):
        for i, j in found:
            a, b = top(r, i), top(r, j)
            r[max(a, b)] = min(a, b)
    assert [top(root, i) for i in range(len(sets))] == [top(want, i) for i in range(len(sets))]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(None, 3), (7, 7), (7, None)]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(60)}


def test_sieve_keeps_what_is_wanted_and_parts_the_rest(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.lit("words").alias("text"))
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 5, 19_999, 50_000)] + [(None,)], "doc_id bigint")
    key = F.struct("doc_id")
    some, rest = (sieved(docs, key, wanted, key, how) for how in ("left_semi", "left_anti"))
    assert "Exchange hashpartitioning(doc_id" not in rest._jdf.queryExecution().executedPlan().toString()
    ids = [r.doc_id for r in some.collect()]
    assert {3, 5, 19_999, None} <= set(ids) and ids.count(None) == 20 and len(ids) < 60
    assert len(ids) + rest.count() == 20_000 and rest.filter("doc_id is null or doc_id in (3, 5, 19999)").isEmpty()
    assert sieved(docs, key, wanted.limit(0), key).isEmpty() and sieved(docs, key, wanted.limit(0), key, "left_anti").count() == 20_000
