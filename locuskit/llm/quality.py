"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit, next to the measurements it
read. A policy is a version and a mask over the bits: applying, changing and comparing
policies never reads a text again. Ablations come from the histogram of bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import gram_hashes, prepare

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
BEYOND_ASCII = bytes(range(128, 256))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_letters", "n_distinct_words"]


def measure(text: str | None) -> tuple:
    """The measurements of one text; null and empty texts measure 0 throughout.

    Letters are A-Z, a-z and all code points beyond ASCII; lines are those with a word.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, seen, copies = len(words), set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            copies += line in seen
            seen.add(line)
    marked = 0
    if n > WINDOW:
        _, first, again = np.unique(gram_hashes(words, WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(again[first] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            marked = int((np.cumsum(edge) > 0).sum())
    blanks = sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    ascii_letters = len(raw.translate(None, NOT_LETTERS + BEYOND_ASCII))
    return (n, len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), copies, marked,
            len(seen) + copies, ascii_letters + len(text) - len(raw.translate(None, BEYOND_ASCII)),
            len(set(words)))


@dataclass(frozen=True)
class Rule:
    """``fails`` says from the measurements whether a document breaks the rule."""

    name: str
    fails: Column | str

    @property
    def column(self) -> Column:
        return F.coalesce(F.expr(self.fails) if isinstance(self.fails, str) else self.fails, F.lit(False))


#: Bit i of the ledger belongs to rule i; append only, so that stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("few_distinct_words", "n_words >= 100 and 20 * n_distinct_words < n_words"),
    Rule("no_text", "n_words = 0"),
)
BASE = ("too_few_words", "repeated_words")
#: Versions of the policy: which rules reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbol_heavy", "duplicate_lines", "few_letters", "no_text"),
    "v2": (*BASE, "symbol_heavy", "duplicate_lines", "few_letters", "no_text", "long_words",
           "short_words", "few_distinct_words"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``ledger_<measure>`` columns and ``ledger_bits``; no shuffle.

    Whole texts are measured. A null text measures as an empty one; repeated rows, null ids
    and further columns pass through unchanged. A column of the input that already has one
    of the new names is replaced.
    """
    prepare(docs.sparkSession)
    new = [f"ledger_{m}" for m in MEASURES]
    kept = [f for f in docs.schema.fields if f.name not in {*new, "ledger_bits"}]
    at = [f.name for f in kept].index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} bigint" for n in new])

    def measured(batches):
        for batch in batches:
            values = [measure(t) for t in batch.column(at).to_pylist()]
            sides = zip(*values) if values else [[]] * len(new)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(list(v), pa.int64()) for v in sides]],
                names=[*batch.schema.names, *new])

    out = docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(measured, schema)
    plain = out.select("*", *[F.col(n).alias(m) for n, m in zip(new, MEASURES)
                              if m not in {f.name for f in kept}])
    clash = [m for m in MEASURES if m in {f.name for f in kept}]
    if clash:  # rules read the measurements, not input columns of the same name
        held = F.struct(*[f"`{f.name}`" for f in kept]).alias("_held")
        plain = out.select(held, *new, *[F.col(n).alias(m) for n, m in zip(new, MEASURES)])
    bits = sum((F.when(r.column, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                for i, r in enumerate(rules)), F.lit(0).cast("bigint"))
    plain = plain.withColumn("ledger_bits", bits)
    return plain.select(*([F.col(f"_held.`{f.name}`").alias(f.name) for f in kept] if clash
                          else [f"`{f.name}`" for f in kept]), *new, "ledger_bits")


def passes(policy: str = "v1", bits: str = "ledger_bits") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("bigint")) == 0


def ablations(ledger_rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, failing, only_this, kept, kept_without): what each rule costs.

    One aggregation gives the histogram of bit patterns (at most 2^rules rows); every
    policy and every dropped rule is then arithmetic on that histogram.
    """
    spark = ledger_rows.sparkSession
    patterns = ledger_rows.groupBy("ledger_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, r, mask_of(names), mask_of((r,), rules)) for p, names in POLICIES.items() for r in names]
    plans = spark.createDataFrame(cases, "policy string, rule string, mask bigint, bit bigint")
    both = patterns.withColumn("_c", F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("mask"),
                 F.lit(b).cast("bigint").alias("bit")) for p, r, m, b in cases])))
    failed = F.col("ledger_bits").bitwiseAND(F.col("_c.mask"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = both.groupBy(F.col("_c.policy").alias("policy"), F.col("_c.rule").alias("rule")).agg(
        count(F.col("ledger_bits").bitwiseAND(F.col("_c.bit")) != 0).alias("failing"),
        count(failed == F.col("_c.bit")).alias("only_this"), count(failed == 0).alias("kept"),
        count((failed == 0) | (failed == F.col("_c.bit"))).alias("kept_without"))
    zero = {c: 0 for c in ("failing", "only_this", "kept", "kept_without")}
    return plans.select("policy", "rule").join(found, ["policy", "rule"], "left").fillna(zero)
