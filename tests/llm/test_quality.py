import re

from locuskit.llm import quality

BLANK = r"[^\x20\x09-\x0D]+"


def plain(text):
    """The measurements from their definitions."""
    text = text or ""
    words = re.findall(BLANK, text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    marked = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    letters = [c for c in text if c > "\x7f" or "A" <= c <= "Z" or "a" <= c <= "z"]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(marked), len(lines), len(letters), len(set(words)))


TEXTS = [None, "", " \n\t\n", "one", "a b c d e f g h " * 3, "same line\nsame line\n\nsame line\nother",
         "# $ | < > & * % " * 4, "na\u00efve \u4e8c\u4e8c \x85 caf\u00e9\u00a0x", "12 34 56 " * 10,
         " ".join(f"word{i}" for i in range(40)), "x" * 50_000, "w v " * 3_000, "a\r\nb\r\na\r\n", "\x1c\x1d a\x1eb"]


def test_measurements_against_definitions():
    for t in TEXTS:
        if t is None or len(t) < 10_000:
            assert quality.measure(t) == plain(t), repr(t)
    assert quality.measure("x" * 50_000)[:2] == (1, 50_000)
    assert quality.measure("w v " * 3_000)[4] == 6_000


def test_bits_follow_measurements_and_rows_stay_whole(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (3, "one"), (3, "one")]
    rows = quality.ledger(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows) == sorted((repr(i), repr(t)) for i, t in docs)
    for r in rows:
        m = dict(zip(quality.MEASURES, quality.measure(r["text"])))
        broken = {rule.name for i, rule in enumerate(quality.RULES) if r["ledger_bits"] >> i & 1}
        assert ("too_few_words" in broken) == (m["n_words"] < 20)
        assert ("repeated_words" in broken) == (100 * m["n_repeat_words"] > 30 * m["n_words"])
        assert ("duplicate_lines" in broken) == (m["n_lines"] > 3 and 10 * m["n_dup_lines"] > 3 * m["n_lines"])
        assert ("long_words" in broken) == (m["word_chars"] > 15 * m["n_words"])
        assert ("few_distinct_words" in broken) == (m["n_words"] >= 100 and 20 * m["n_distinct_words"] < m["n_words"])
        assert ("no_text" in broken) == (m["n_words"] == 0)


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "few words", 99, 7, "x")],
                                 "doc_id int, text string, n_words int, ledger_bits int, _held string")
    out = quality.ledger(docs)
    r = out.collect()[0]
    assert (r["n_words"], r["_held"], r["ledger_n_words"]) == (99, "x", 2)
    assert r["ledger_bits"] & 1 and out.columns.count("ledger_bits") == 1
    assert not out.select(quality.passes("base").alias("p")).first()["p"]


def test_empty_table(spark):
    none = quality.ledger(spark.createDataFrame([], "doc_id int, text string"))
    assert none.count() == 0
    counts = quality.ablations(none)
    assert counts.count() == sum(len(p) for p in quality.POLICIES.values())
    assert counts.filter("failing + only_this + kept + kept_without > 0").count() == 0


def test_ablations_against_the_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id int, text string")
    bits = [r["ledger_bits"] for r in quality.ledger(docs).collect()]
    at = {rule.name: 1 << i for i, rule in enumerate(quality.RULES)}
    want = set()
    for policy, names in quality.POLICIES.items():
        mask = sum(at[n] for n in names)
        for n in names:
            want.add((policy, n, sum(bool(b & at[n]) for b in bits), sum(b & mask == at[n] for b in bits),
                      sum(not b & mask for b in bits), sum(not b & (mask ^ at[n]) for b in bits)))
    assert {tuple(r) for r in quality.ablations(quality.ledger(docs)).collect()} == want
