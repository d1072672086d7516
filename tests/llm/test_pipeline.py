import re

import duckdb

import corpus_pipeline as cp
from locuskit.llm.decontaminate_query import SQL as WINDOWS
from locuskit.llm.near_dedup_query import SQL as LINKS
from locuskit.llm.quality_query import SQL as RULES
from test_packing import whole
from test_pii import PATTERNS, ok

SF = "/root/testdata/sf0.001"


def test_equals_sql_and_brute_force(spark):
    db = duckdb.connect()
    db.sql(f"create table benchmark as from '{SF}/benchmark.parquet'")
    db.sql(f"create table documents as from '{SF}/documents.parquet'")
    for sql, test in ((RULES, "kept"), (LINKS, "kept"), (WINDOWS, "not contaminated")):
        ids = [r[0] for r in db.sql(f"select doc_id from ({sql}) where {test}").fetchall()]
        db.execute("create or replace table documents as select * from documents where list_contains(?, doc_id)", [ids])
    want = dict(db.sql("select doc_id, text from documents").fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = cp.stored(stage(spark, docs, SF), "test_stage")
        assert docs.columns == columns
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got.keys() == want.keys() and docs.count() == len(got)
    for i, text in want.items():
        spans = sorted((m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text, re.ASCII) if ok(k, m[0]))
        assert all(text[a:b] not in got[i]["text"] for a, b, _ in spans) and got[i]["n_chars"] == len(got[i]["text"])
        if not re.search(r"[0-9@]", text):
            assert got[i]["text"] == text
    pieces = cp.packing(spark, docs, SF).collect()
    held = {}
    for r in pieces:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == {i: len(whole(r["text"])) for i, r in got.items()}


def test_hard_rows(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, text, "a", 3), (1, text, "a", 3), (2, text, "b", 3), (None, "", None, None), (4, None, None, None),
            (5, text[::-1] + " mail x.y@z.org", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ledger_bits string, _row int")
    for table, ids in ((docs, [1, 5]), (docs.limit(0), [])):
        for _, stage in cp.STAGES[:-1]:
            table = cp.stored(stage(spark, table, SF), "test_hard")
            assert table.columns == docs.columns
        assert sorted(r["doc_id"] for r in table.collect()) == ids
    assert cp.packing(spark, docs.limit(0), SF).count() == 0
