"""op1: all documents into eight shards, and where they go with a ninth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.registry import query
from locuskit.llm.sharding import Node, build, grown, shard_rows

TREE = build(8)


def _descend(name: str, tree: Node) -> str:
    """SQL that walks the listed nodes level by level."""
    listed = ", ".join(f"('{n.path}', '{c.path}', {c.weight}::double, {-1 if c.shard is None else c.shard})"
                       for n in tree.nodes() for c in n.children)
    steps = [f"{name}_t(up, path, weight, shard) as (values {listed})"]
    for level in range(tree.depth):
        old = "(select k, '' as path from keys)" if level == 0 else f"{name}_{level}"
        steps.append(f"""{name}_{level + 1} as (
  select k, arg_min(path, (dr, path)) as path, arg_min(shard, (dr, path)) as shard from (
    select o.k, t.path, t.shard, -ln((('0x' || md5(o.k || '|' || t.path)[1:13])::bigint + 0.5)
      / 4503599627370496.0::double) / t.weight as dr
    from {old} o join {name}_t t on t.up = o.path) group by k)""")
    return ",\n".join(steps)


def sql() -> str:
    return f"""
with docs as (
  select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, strlen(coalesce(text, '')) + 1 as size,
    coalesce(text, '') as text from documents),
keys as (select distinct k from docs),
bits as (select g.generate_series as c, list_reduce(list_prepend(g.generate_series::ubigint, range(8)::ubigint[]),
  lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from generate_series(0, 255) g),
crc_table as (select list(v order by c) as t from bits),
sums as (select text, xor(list_reduce(list_prepend(4294967295::ubigint,
    list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:-2],
      lambda h: ('0x' || h)::ubigint)),
    lambda c, b: xor(t[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295)::bigint as text_crc32
  from (select distinct text from docs), crc_table),
{_descend("a", TREE)},
{_descend("b", grown(TREE))},
rows_ as (select doc_id, size::bigint as size, text_crc32, a_3.shard::int as shard, b_3.shard::int as grown_shard,
    md5('slot|' || k || '|' || text_crc32)[1:3] as piece
  from docs join sums using (text) join a_3 using (k) join b_3 using (k))
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by piece, doc_id nulls first, size, text_crc32) - 1 as slot,
  grown_shard from rows_
"""


@query("op1_hash_tree", sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"), TREE,
                      next_tree=grown(TREE))
