"""Versions that queries merge, made from the given tables by fixed rules, and the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours, theirs of orders as (k, status, priority)."""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    old = k % 11 != 0
    status_o = F.when(old & (k % 9 == 0), "S").when(old & (k % 5 == 0), "X").when(~old & (k % 22 == 0), "A").otherwise(F.col("status"))
    status_t = F.when(old & (k % 9 == 0), "S").when(old & (k % 49 == 0), "Y").otherwise(F.col("status"))
    priority_t = F.when(old & (k % 7 == 0) & (k % 9 != 0), "Z").otherwise(F.col("priority"))
    ours = rows.filter(~((k % 13 == 1) | ((k % 11 == 0) & (k % 3 == 1)))).withColumn("status", status_o)
    theirs = rows.filter(~((k % 17 == 2) | ((k % 11 == 0) & (k % 3 == 2)))).withColumns({"status": status_t, "priority": priority_t})
    return rows.filter(old), ours, theirs


ORDER_VERSIONS_SQL = """
src AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
base AS (SELECT * FROM src WHERE k % 11 <> 0),
ours AS (
  SELECT k, CASE WHEN k % 11 <> 0 AND k % 9 = 0 THEN 'S' WHEN k % 11 <> 0 AND k % 5 = 0 THEN 'X'
                 WHEN k % 22 = 0 THEN 'A' ELSE status END AS status, priority
  FROM src WHERE NOT (k % 13 = 1 OR (k % 11 = 0 AND k % 3 = 1))),
theirs AS (
  SELECT k, CASE WHEN k % 11 <> 0 AND k % 9 = 0 THEN 'S' WHEN k % 11 <> 0 AND k % 49 = 0 THEN 'Y' ELSE status END AS status,
         CASE WHEN k % 11 <> 0 AND k % 7 = 0 AND k % 9 <> 0 THEN 'Z' ELSE priority END AS priority
  FROM src WHERE NOT (k % 17 = 2 OR (k % 11 = 0 AND k % 3 = 2))),
aligned AS (
  SELECT coalesce(b.k, o.k, t.k) AS k, b.k IS NOT NULL AS ib, o.k IS NOT NULL AS io, t.k IS NOT NULL AS it,
         b.status AS bs, o.status AS os, t.status AS ts, b.priority AS bp, o.priority AS op, t.priority AS tp
  FROM base b FULL JOIN ours o ON b.k = o.k FULL JOIN theirs t ON coalesce(b.k, o.k) = t.k),
classed AS (
  SELECT *, CASE
    WHEN ib AND io AND it THEN CASE
      WHEN os = bs AND op = bp AND ts = bs AND tp = bp THEN 'unchanged'
      WHEN ts = bs AND tp = bp THEN 'ours_only'
      WHEN os = bs AND op = bp THEN 'theirs_only'
      WHEN os = ts AND op = tp THEN 'both_same'
      WHEN (os <> bs AND ts <> bs AND os <> ts) OR (op <> bp AND tp <> bp AND op <> tp) THEN 'conflict_both_modified'
      ELSE 'field_merged' END
    WHEN ib AND io THEN CASE WHEN os <> bs OR op <> bp THEN 'conflict_modify_delete_ours' ELSE 'deleted_by_theirs' END
    WHEN ib AND it THEN CASE WHEN ts <> bs OR tp <> bp THEN 'conflict_modify_delete_theirs' ELSE 'deleted_by_ours' END
    WHEN ib THEN 'deleted_both'
    WHEN io AND it THEN CASE WHEN os = ts AND op = tp THEN 'added_same' ELSE 'conflict_both_added' END
    WHEN io THEN 'added_ours' ELSE 'added_theirs' END AS resolution
  FROM aligned)
"""


def text_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base, ours, theirs: documents with an import block in front and per-side line edits."""
    d = F.col("doc_id")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    edited = lambda m, mark: F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + d) % m == 0, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    head = F.concat(F.lit("import alpha\nimport beta"), (d % 3).cast("string"), F.lit("\n"))
    mine = F.concat(F.when(d % 2 == 0, head).otherwise(F.lit("import alpha\n")), F.lit("import ours"), (d % 4).cast("string"), F.lit("\n"))
    other = F.concat(head, F.lit("import theirs"), (d % 5).cast("string"), F.lit("\n"))
    return docs.select("doc_id", F.concat(head, F.col("text")).alias("base"), F.concat(mine, edited(5, " // o")).alias("ours"), F.concat(other, edited(7, " # t")).alias("theirs"))


TEXT_VERSIONS_SQL = r"""
docs AS (SELECT doc_id AS d, coalesce(text, '') AS text, 'import alpha' || chr(10) || 'import beta' || (doc_id % 3) || chr(10) AS head FROM documents),
versions AS (
  SELECT d AS doc_id, head || text AS base,
    CASE WHEN d % 2 = 0 THEN head ELSE 'import alpha' || chr(10) END || 'import ours' || (d % 4) || chr(10)
      || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1 + d) % 5 = 0 THEN x || ' // o' ELSE x END), chr(10)) AS ours,
    head || 'import theirs' || (d % 5) || chr(10)
      || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1 + d) % 7 = 0 THEN x || ' # t' ELSE x END), chr(10)) AS theirs
  FROM docs)
"""


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an operation log; times in milliseconds."""
    ops = F.col("event_type")
    op = F.when(ops == "signup", "register").when(ops == "view", "heartbeat").when(ops == "click", "claim").when(ops == "error", "release").otherwise("modify")
    return table(spark, sf_dir, "events").select(
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_id"),
        F.concat(F.lit("entity"), (F.floor("value").cast("long") % 50).cast("string")).alias("entity_id"),
        op.alias("op"),
        F.md5(F.col("props").cast("binary")).alias("payload"),
    )


LOG_SQL = """
log AS (
  SELECT epoch_us(ts) // 1000 AS ts, event_id AS seq, 'agent' || user_id AS agent_id, 'entity' || (CAST(floor(value) AS BIGINT) % 50) AS entity_id,
         CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'release' ELSE 'modify' END AS op,
         md5(props) AS payload
  FROM events)
"""


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst): a supplier's entity depends on the parts that it delivers, a part on the part of half its number."""
    named = lambda mark, k: F.concat(F.lit(mark), k.cast("string"))
    items = table(spark, sf_dir, "lineitem").select(named("s", F.col("l_suppkey")).alias("src"), named("p", F.col("l_partkey")).alias("dst"))
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").filter(k > 1).select(named("p", k).alias("src"), named("p", F.floor(k / 2)).alias("dst"))
    return items.union(parts).distinct()


GRAPH_SQL = """
edges AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT 'p' || p_partkey, 'p' || (p_partkey // 2) FROM part WHERE p_partkey > 1)
"""


def name_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours, theirs entities (entity_id, ord, content, body_hash, structural_hash) from part, with renames by key."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")

    def entities(name) -> DataFrame:
        content = F.concat(F.lit("def "), name, F.lit("(x): return x * "), (k % 1009).cast("string"), F.lit(" # "), F.col("p_type"))
        body = F.md5(F.concat(F.lit("def __ENTITY__(x): return x * "), (k % 1009).cast("string"), F.lit(" # "), F.col("p_type")).cast("binary"))
        shape = F.md5(F.concat(F.lit("S"), (k % 1009).cast("string"), F.lit("-"), F.col("p_size").cast("string")).cast("binary"))
        return part.select(name.alias("entity_id"), k.alias("ord"), content.alias("content"), body.alias("body_hash"), shape.alias("structural_hash"))

    old = F.concat(F.lit("f"), k.cast("string"))
    ours = F.when(k % 7 == 0, F.concat(F.lit("g"), k.cast("string"))).otherwise(old)
    theirs = F.when(k % 5 == 0, F.concat(F.lit("h"), k.cast("string"))).otherwise(old)
    return entities(old), entities(ours), entities(theirs)


NAMES_SQL = """
p AS (SELECT p_partkey AS k, p_type, p_size FROM part),
bodies AS (SELECT k, md5('def __ENTITY__(x): return x * ' || (k % 1009) || ' # ' || p_type) AS body, md5('S' || (k % 1009) || '-' || p_size) AS shape FROM p),
base AS (SELECT 'f' || k AS entity_id, k AS ord, body, shape FROM bodies),
ours AS (SELECT CASE WHEN k % 7 = 0 THEN 'g' ELSE 'f' END || k AS entity_id, k AS ord, body, shape FROM bodies),
theirs AS (SELECT CASE WHEN k % 5 = 0 THEN 'h' ELSE 'f' END || k AS entity_id, k AS ord, body, shape FROM bodies)
"""


def renames_sql(side: str) -> str:
    return f"""
{side}_bodies AS (SELECT body, max_by(entity_id, ord) AS id FROM base GROUP BY body),
{side}_shapes AS (SELECT shape, max_by(entity_id, ord) AS id FROM base GROUP BY shape),
{side}_hits AS (
  SELECT n.entity_id AS branch_id, n.ord, coalesce(b.id, s.id) AS base_id
  FROM {side} n LEFT JOIN {side}_bodies b ON b.body = n.body LEFT JOIN {side}_shapes s ON s.shape = n.shape
  WHERE n.entity_id NOT IN (SELECT entity_id FROM base)),
{side}_renames AS (
  SELECT base_id, min_by(branch_id, ord) AS branch_id FROM {side}_hits
  WHERE base_id IS NOT NULL AND base_id NOT IN (SELECT entity_id FROM {side}) GROUP BY base_id)
"""
