"""op10: the quality ledger over all documents, and what each rule of each policy costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm import quality
from locuskit.llm.common import read_table
from locuskit.llm.registry import query

MEASURED = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
starts as (
  select r, g.generate_series as i, array_to_string(ws[g.generate_series:g.generate_series + 7], ' ') as gram
  from w, generate_series(1, len(ws) - 7) g where len(ws) >= 8),
again as (select r, i from (select r, i, count(*) over (partition by r, gram) as c from starts) where c > 1),
repeated as (
  select r, count(distinct i + o.generate_series) as n_repeat_words
  from again, generate_series(0, 7) o group by r),
line as (
  select r, l, count(*) as c from (select r, unnest(string_split(text, chr(10))) as l from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by r, l),
lines as (select r, sum(c)::bigint as n_lines, sum(c - 1)::bigint as n_dup_lines from line group by r),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines, len(list_distinct(ws))::bigint as n_distinct_words,
    length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::bigint as n_letters
  from w left join repeated using (r) left join lines using (r)),
"""

SQL = MEASURED + r"""
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or (n_lines > 3 and 10 * n_dup_lines > 3 * n_lines)
       or 2 * n_letters < word_chars) as kept
from b
"""

ABLATIONS = MEASURED + r"""
failed as (
  select r, rule from (
    select row_number() over () as r, n_words < 20 as too_few_words,
      100 * n_repeat_words > 30 * n_words as repeated_words, 10 * n_symbols > 3 * n_words as symbol_heavy,
      n_lines > 3 and 10 * n_dup_lines > 3 * n_lines as duplicate_lines, 2 * n_letters < word_chars as few_letters,
      word_chars > 15 * n_words as long_words, word_chars < 2 * n_words as short_words,
      n_words >= 100 and 20 * n_distinct_words < n_words as few_distinct_words, n_words = 0 as no_text from m)
  unpivot (fails for rule in (too_few_words, repeated_words, symbol_heavy, duplicate_lines, few_letters, long_words,
                              short_words, few_distinct_words, no_text)) where fails),
policies(policy, rule) as (values POLICY_RULES),
broken as (  -- the rules of a policy that a document breaks
  select policy, r, count(*) as c, any_value(rule) as one from failed join policies using (rule) group by policy, r),
rejected as (select policy, count(*) as n from broken group by policy),
single as (select policy, one as rule, count(*) as n from broken where c = 1 group by policy, one),
each_rule as (select rule, count(*) as n from failed group by rule),
size as (select count(*) as n from m)
select p.policy, p.rule, coalesce(e.n, 0)::bigint as failing, coalesce(s.n, 0)::bigint as only_this,
  (size.n - coalesce(j.n, 0))::bigint as kept, (size.n - coalesce(j.n, 0) + coalesce(s.n, 0))::bigint as kept_without
from policies p left join each_rule e using (rule) left join rejected j on j.policy = p.policy
left join single s on s.policy = p.policy and s.rule = p.rule, size
""".replace("POLICY_RULES", ", ".join(f"('{p}', '{r}')" for p, rules in quality.POLICIES.items() for r in rules))


@query("op10_rule_ledger", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", *[F.col(f"ledger_{m}").alias(m) for m in quality.MEASURES[:5]],
        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"))


@query("quality_ablations", ABLATIONS)
def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, rule, failing, only_this, kept, kept_without) over all documents."""
    return quality.ablations(quality.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
