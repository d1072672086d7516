import random
import re
import time

from pyspark.sql import functions as F

from locuskit.llm.pii import IDENTIFIER, KINDS, _DOT, _spans, extracted, masked, personal_data
from locuskit.llm.pii_query import op5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [None, "", "no data", "é a.b@c.de.f, x@y @z.de a@b..c 1.2.3.4.5 256.1.1.1 001.2.3.4", "_@a.b_c@d.e..f@g.h",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "call +1 (743) 555-3824 or +12 34", "+1.2.3.4 5678 90-",
         "a.b@c.de " * 600, "9" * 20_000, "a." * 9000 + "@b" + ".c" * 9000, "\x01x\x024.4.4.4\x01 4111\x011111"]
TEXTS += [f'k{i} id token = "{i:032x}af" end' for i in range(100, 112)] + ['my token = "ghp_12ab34" x']


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        w = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(w) % 10 == 0
    return True


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "", re.ASCII) if ok(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_base_and_discovered(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op5(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        mine = [s for s in rows[i]["spans"].split(",") if s and s.split(":")[0] != "secret"]
        assert mine == brute(t), t[:60] if t else t
        import hashlib
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(brute(t)).encode()).hexdigest()
    assert rows[len(TEXTS) - 1]["spans"] == "secret:12:22"  # no shape knows it; the pattern does


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, _row int, pii_text string")
    assert personal_data(empty, keep=("doc_id",)).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.cd 1.2.3.4", "k"), (None, None, "k"), (1, "x a@b.cd 1.2.3.4", "k")],
                                 "doc_id int, text string, start string")
    out = personal_data(docs, keep=("doc_id", "text", "start")).select("doc_id", masked(F.col("text"), F.col("pii_spans")).alias("t"))
    assert sorted((str(r[0]), str(r[1])) for r in out.collect()) == [
        ("1", "x <email> <ip>"), ("1", "x <email> <ip>"), ("None", "None")]


def test_many_spans_in_one_text(spark):
    """100,000 addresses in a text, masked in a time that follows its length; blocks keep every span."""
    one = "write to a.b@c.de or 10.2.3.4, id x9y8z7w6 "
    text = one * 50_000
    docs = spark.createDataFrame([(1, text), (2, one * 700), (3, "é " + one * 513 + "end")], "doc_id int, text string").repartition(3)
    begin = time.monotonic()
    rows = personal_data(docs, keep=("doc_id", "text")).select(
        "doc_id", F.size("pii_spans").alias("n"), masked(F.col("text"), F.col("pii_spans")).alias("t"),
        F.transform(F.filter("pii_spans", lambda s: s["kind"] == "ip"), lambda s: s["start"]).alias("at")).collect()
    assert time.monotonic() - begin < 90
    found = {r["doc_id"]: r for r in rows}
    changed = "write to <email> or <ip>, id x9y8z7w6 "
    assert found[1]["t"] == changed * 50_000 and found[1]["n"] == 100_000
    assert found[2]["t"] == changed * 700 and found[3]["t"] == "é " + changed * 513 + "end"
    assert found[1]["at"] == [m.start() for m in re.finditer("10[.]2", text)]


def test_identifiers_that_seeds_overlap(spark):
    """Those free of seeds, against the definition over all pairs."""
    rng = random.Random(5)
    pieces = ["a1b2c3@d.ef", "1.2.3.4", "x9y8z7", " ", "  ", "-", ".", "@", "4111111111111111", "+1 743 555 38 24", "ab12cd34", "_", "0af" * 11]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = extracted(docs)
    every = _spans(F.col("pii_dots"), IDENTIFIER, "other", len(KINDS), lambda v: F.lit(True))
    dots = F.regexp_replace(F.translate("text", "\x01\x02", "\x03\x03"), _DOT, "\x02")
    both = rows.withColumn("pii_dots", dots).select("pii_seeds", "pii_others", every.alias("all")).collect()
    assert sum(len(r["all"]) for r in both) > sum(len(r["pii_others"]) for r in both) > 0
    for r in both:
        assert r["pii_others"] == [o for o in r["all"] if not any(
            s["start"] < o["end"] and o["start"] < s["end"] for s in r["pii_seeds"])]
