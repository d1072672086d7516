import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from locuskit.llm.simhash import as_hex, fingerprint, simhash_duplicates

SCHEMA = "doc_id bigint, text string, print string, component_id int"


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance):
    """The least index reachable, every pair compared."""
    v = np.array(prints, np.uint64)
    root = list(range(len(v)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= distance):
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(v))]


def brute(docs, distance=2):
    prints = [plain(t) for _, t in docs]
    of = classes(prints, distance)
    least = {}
    for (i, _), c in zip(docs, of):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(docs, prints, of)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", as_hex(F.col("print")), "component_id").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], SCHEMA)


def varied(rng, n, words=60):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(words)] = f"x{rng.randrange(50)}"
        out.append(" ".join(ws))
    return out


def test_hash_equals_the_built_in(spark):
    row = spark.sql("select hex(xxhash64('a b c')) as h").first()
    assert int(row["h"], 16) == fingerprint("A b\tC", 3) == plain("a b c")


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (None, "a"), (5, "a"), (5, "A"), (6, "é b ü"), (7, "É b ü"), (8, "a b"),
            (9, "one two three four"), (9, "one two three four"), (None, None)]
    assert got(simhash_duplicates(frame(spark, docs))) == brute(docs)
    lone = [(None, "only this"), (None, "only this")]
    assert got(simhash_duplicates(frame(spark, lone))) == brute(lone)


def test_empty_table(spark):
    assert got(simhash_duplicates(frame(spark, []))) == []


def test_very_long_text_is_hashed_whole(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(150_000))
    assert fingerprint(text, 3) == plain(text)


def test_equals_brute_force_on_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    docs += [(100_000 + i, t) for i, t in enumerate(varied(rng, 300) + varied(rng, 300, 400))]
    assert got(simhash_duplicates(frame(spark, docs))) == brute(docs)


def test_crowded_entries_give_the_same_components(spark):
    rng = random.Random(7)
    docs = [(i, t) for i, t in enumerate(varied(rng, 250) + varied(rng, 150, 200))]
    for distance in (1, 2, 3):
        want = brute(docs, distance)
        assert got(simhash_duplicates(frame(spark, docs), distance=distance)) == want
        if distance < 3:
            assert got(simhash_duplicates(frame(spark, docs), distance=distance, crowd=2)) == want


def test_links_of_drawn_fingerprints(spark):
    """Random 64-bit values around a few centres, every pair compared."""
    from locuskit.llm.common import Scratch, prepare
    from locuskit.llm.components import components
    from locuskit.llm.simhash import links
    rng = random.Random(11)
    held = set()
    for c in [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1, 1 << 63]:
        for _ in range(60):
            v = c
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            held.add(v)
    held = sorted(held)
    signed = [v - (1 << 64) if v >> 63 else v for v in held]
    prints = spark.createDataFrame([(v,) for v in signed], "print bigint")
    for distance, crowd in ((1, 256), (2, 256), (2, 2), (3, 256)):
        found = components(links(prints, distance, Scratch(prepare(spark), "t"), crowd)).collect()
        root = dict(zip(signed, signed)) | {r["node"]: r["root"] for r in found}
        groups, want = {}, {}
        for v, c in zip(signed, classes(held, distance)):
            groups.setdefault(root[v], set()).add(v)
            want.setdefault(c, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
