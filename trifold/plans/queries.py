"""One query per operator. SQL for all that SQL expresses is in ORACLE_SQL, under the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.functions import text
from trifold.functions.markers import ParseConflicts
from trifold.operators import align, bench, entities, files, graph, state
from trifold.plans import fixtures as fx

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}
VALUES = ["status", "priority"]
#: Claims and releases, replayed one step of every entity at a time.
CLAIMS_SQL = """steps AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, seq) AS rn FROM log WHERE op IN ('claim', 'release')),
folded AS (
  SELECT entity_id, ts, seq, agent_id, op, rn, CASE op WHEN 'claim' THEN 'claimed' ELSE 'ignored' END AS outcome, CASE op WHEN 'claim' THEN agent_id END AS claimed_by FROM steps WHERE rn = 1
  UNION ALL
  SELECT s.entity_id, s.ts, s.seq, s.agent_id, s.op, s.rn,
    CASE WHEN s.op = 'release' THEN CASE WHEN f.claimed_by = s.agent_id THEN 'released' ELSE 'ignored' END
         WHEN f.claimed_by IS NULL THEN 'claimed' WHEN f.claimed_by = s.agent_id THEN 'already_owned_by_self' ELSE 'already_claimed' END,
    CASE WHEN s.op = 'claim' THEN coalesce(f.claimed_by, s.agent_id) WHEN f.claimed_by = s.agent_id THEN NULL ELSE f.claimed_by END
  FROM folded f JOIN steps s ON s.entity_id = f.entity_id AND s.rn = f.rn + 1),
claims AS (SELECT entity_id, arg_max(coalesce(claimed_by, ''), rn) AS claimed_by FROM folded GROUP BY entity_id HAVING arg_max(coalesce(claimed_by, ''), rn) <> '')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def aligned_orders(spark: SparkSession, d: str, hashed: bool = False) -> DataFrame:
    versions = fx.order_versions(spark, d)
    if hashed:
        versions = tuple(align.hashed(v, ["k"], VALUES) for v in versions)
    return align.align(*versions, ["k"], VALUES)


# ---- rows as entities

@query(f"WITH {fx.ORDER_VERSIONS_SQL} SELECT resolution, count(*) AS n FROM classed GROUP BY resolution")
def merge3_rows_stats(spark: SparkSession, d: str) -> DataFrame:
    classes = aligned_orders(spark, d, hashed=True).select(align.resolution(VALUES).alias("resolution"))
    return classes.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}
SELECT k, resolution,
  CASE WHEN resolution LIKE 'conflict%' OR resolution LIKE 'deleted%' THEN NULL
       WHEN ib AND io AND it THEN CASE WHEN os = bs THEN ts ELSE os END ELSE coalesce(os, ts) END AS status,
  CASE WHEN resolution LIKE 'conflict%' OR resolution LIKE 'deleted%' THEN NULL
       WHEN ib AND io AND it THEN CASE WHEN op = bp THEN tp ELSE op END ELSE coalesce(op, tp) END AS priority
FROM classed""")
def merge3_rows_resolved(spark: SparkSession, d: str) -> DataFrame:
    return align.resolved(aligned_orders(spark, d), VALUES).select("k", "resolution", *VALUES)


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}
SELECT k, resolution, bs AS base_status, os AS ours_status, ts AS theirs_status, bp AS base_priority, op AS ours_priority, tp AS theirs_priority
FROM classed WHERE resolution LIKE 'conflict%'""")
def merge3_rows_conflicts(spark: SparkSession, d: str) -> DataFrame:
    out = aligned_orders(spark, d).withColumn("resolution", align.resolution(VALUES)).filter(F.startswith("resolution", F.lit("conflict")))
    return out.select("k", "resolution", *[f"{s}_{v}" for v in VALUES for s in align.SIDES])


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}, s AS (
  SELECT k % 100 AS file, count(*) FILTER (resolution = 'unchanged') AS unchanged, count(*) FILTER (resolution = 'ours_only') AS ours_only,
    count(*) FILTER (resolution = 'theirs_only') AS theirs_only, count(*) FILTER (resolution IN ('both_same', 'field_merged')) AS both_changed_merged,
    count(*) FILTER (resolution IN ('added_ours', 'added_same')) AS added_ours, count(*) FILTER (resolution = 'added_theirs') AS added_theirs,
    count(*) FILTER (resolution LIKE 'deleted%') AS deleted, count(*) FILTER (resolution LIKE 'conflict%') AS conflicted,
    count(*) FILTER (resolution = 'field_merged') AS inner_merged
  FROM classed GROUP BY file)
SELECT *, CASE WHEN conflicted > 0 THEN 'conflict' WHEN inner_merged > 0 THEN 'medium' ELSE 'very_high' END AS confidence FROM s""")
def merge3_confidence(spark: SparkSession, d: str) -> DataFrame:
    classes = aligned_orders(spark, d, hashed=True).select((F.col("k") % 100).alias("file"), align.resolution(VALUES).alias("c"))
    c = F.col("c")
    stats = classes.groupBy("file").agg(*[v.alias(k) for k, v in align.counters(c).items()], F.count_if(c == "field_merged").alias("inner_merged"))
    return stats.withColumn("confidence", align.confidence(F.col("conflicted"), F.col("inner_merged"), F.lit(False), F.lit(0)))


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}, s AS (SELECT k % 100 AS file, count(*) FILTER (resolution LIKE 'conflict%') AS c, count(*) FILTER (resolution = 'field_merged') AS m FROM classed GROUP BY file)
SELECT count(*) AS files, count(*) FILTER (c = 0) AS clean, count(*) FILTER (c > 0) AS conflicted, CASE WHEN max(c) > 0 THEN 'conflict' WHEN max(m) > 0 THEN 'medium' ELSE 'very_high' END AS confidence FROM s""")
def preview_summary(spark: SparkSession, d: str) -> DataFrame:
    f = merge3_confidence(spark, d)
    level = align.confidence(F.max("conflicted"), F.max("inner_merged"), F.lit(False), F.lit(0))
    return f.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("conflicted") == 0).alias("clean"), F.count_if(F.col("conflicted") > 0).alias("conflicted"), level.alias("confidence"))


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}, s AS (SELECT k % 10 AS file, count(*) FILTER (resolution = 'unchanged') AS u, count(*) FILTER (resolution = 'ours_only') AS o, count(*) FILTER (resolution LIKE 'conflict%') AS c FROM classed GROUP BY file)
SELECT file, 'unchanged: ' || u || CASE WHEN o > 0 THEN ', ours-only: ' || o ELSE '' END || CASE WHEN c > 0 THEN ', CONFLICTS: ' || c ELSE '' END AS line FROM s""")
def stats_line(spark: SparkSession, d: str) -> DataFrame:
    classes = aligned_orders(spark, d, hashed=True).select((F.col("k") % 10).alias("file"), align.resolution(VALUES).alias("c"))
    s = classes.groupBy("file").agg(*[align.counters(F.col("c"))[x].alias(x) for x in ("unchanged", "ours_only", "conflicted")])
    return s.select("file", text.stats_text({x: F.col(x) for x in ("unchanged", "ours_only", "conflicted")}).alias("line"))


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}
SELECT k, CASE WHEN b.k IS NULL THEN 'added' WHEN o.k IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM (SELECT k AS bk, * FROM base) b FULL JOIN (SELECT k AS ok, * FROM ours) o USING (k)
WHERE b.bk IS NULL OR o.ok IS NULL OR b.status <> o.status OR b.priority <> o.priority""".replace("b.k IS", "b.bk IS").replace("o.k IS", "o.ok IS"))
def semantic_diff(spark: SparkSession, d: str) -> DataFrame:
    base, ours, _ = fx.order_versions(spark, d)
    keyed = lambda x: x.select("k", F.concat_ws("|", *VALUES).alias("h"))
    return entities.semantic_diff(keyed(base), keyed(ours), "k", "h")


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}
SELECT DISTINCT o.k % 50 AS file, o.k FROM ours o LEFT JOIN base b ON o.k = b.k WHERE b.k IS NULL OR b.status <> o.status OR b.priority <> o.priority""")
def modified_by_name(spark: SparkSession, d: str) -> DataFrame:
    base, ours, _ = fx.order_versions(spark, d)
    keyed = lambda x: x.select((F.col("k") % 50).alias("file"), "k", F.xxhash64(*VALUES).alias("h"))
    return entities.modified_by_name(keyed(base), keyed(ours), ["file", "k"], "h")


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}
SELECT k FROM ours JOIN base USING (k) WHERE ours.status <> base.status OR ours.priority <> base.priority
INTERSECT SELECT k FROM theirs JOIN base USING (k) WHERE theirs.status <> base.status OR theirs.priority <> base.priority""")
def changed_in_both(spark: SparkSession, d: str) -> DataFrame:
    base, ours, theirs = (align.hashed(x, ["k"], VALUES) for x in fx.order_versions(spark, d))
    edited = lambda x: x.join(base.select("k", *[F.col(v).alias(f"b_{v}") for v in VALUES]), "k").filter(" or ".join(f"{v} <> b_{v}" for v in VALUES))
    return entities.changed_in_both(edited(ours), edited(theirs), "k")


# ---- renames

@query(f"WITH {fx.NAMES_SQL}, {fx.renames_sql('ours')} SELECT branch_id, base_id FROM ours_renames")
def rename_detect(spark: SparkSession, d: str) -> DataFrame:
    base, ours, _ = fx.name_tables(spark, d)
    return entities.renames(base, ours)


@query(f"""WITH {fx.NAMES_SQL}, {fx.renames_sql('ours')}, {fx.renames_sql('theirs')}
SELECT o.base_id, o.branch_id AS ours_id, t.branch_id AS theirs_id FROM ours_renames o JOIN theirs_renames t ON o.base_id = t.base_id WHERE o.branch_id <> t.branch_id""")
def rename_rename(spark: SparkSession, d: str) -> DataFrame:
    base, ours, theirs = fx.name_tables(spark, d)
    return entities.rename_conflicts(entities.renames(base, ours), entities.renames(base, theirs))


@query(f"""WITH {fx.NAMES_SQL}, {fx.renames_sql('ours')},
changes AS (SELECT entity_id, CASE WHEN b.k IS NULL THEN 'added' ELSE 'deleted' END AS change FROM (SELECT entity_id, ord AS k FROM base) b FULL JOIN (SELECT entity_id, ord AS m FROM ours) o USING (entity_id) WHERE b.k IS NULL OR o.m IS NULL)
SELECT entity_id, CASE WHEN base_id IS NULL THEN change ELSE 'renamed' END AS change, base_id AS was FROM changes LEFT JOIN ours_renames ON branch_id = entity_id WHERE entity_id NOT IN (SELECT base_id FROM ours_renames)""")
def diff_with_renames(spark: SparkSession, d: str) -> DataFrame:
    base, ours, _ = (x.withColumn("content_hash", F.col("body_hash")) for x in fx.name_tables(spark, d))
    return entities.diff_with_renames(base, ours)


@query(f"WITH {fx.NAMES_SQL} SELECT entity_id, body AS body_hash FROM ours")
def word_boundary_normalize(spark: SparkSession, d: str) -> DataFrame:
    _, ours, _ = fx.name_tables(spark, d)
    return ours.select("entity_id", text.body_hash(F.col("content"), F.col("entity_id")).alias("body_hash"))


# ---- ranges, names and order within files

# a file is 32 orders, and every line item is an entity of it
RANGES_SQL = "e AS (SELECT l_orderkey // 32 AS file, l_orderkey * 10 + l_linenumber AS k, l_partkey % 200 AS start_line, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS end_line FROM lineitem)"


def ranges(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_partkey") % 200
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return fx.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 32).alias("file"), key.alias("k"), start.alias("start_line"), (start + F.col("l_quantity").cast("long")).alias("end_line"))


@query(f"""WITH {RANGES_SQL}, r AS (SELECT DISTINCT file, start_line, end_line FROM e),
reach AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT file, k, start_line, end_line FROM e JOIN reach USING (file, start_line, end_line) WHERE before IS NULL OR before < end_line""")
def nested_filter(spark: SparkSession, d: str) -> DataFrame:
    return entities.outermost(ranges(spark, d), ["file"]).select("file", "k", "start_line", "end_line")


@query("SELECT file, max(n) AS most FROM (SELECT l_orderkey AS file, l_suppkey % 3 AS name, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY file HAVING max(n) >= 5")
def duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    named = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 3).alias("name"))
    return entities.excessive_duplicates(named, ["file"], "name")


@query(f"WITH {RANGES_SQL} SELECT file, k, lag(k) OVER (PARTITION BY file ORDER BY start_line, k) AS predecessor FROM e")
def predecessor_lag(spark: SparkSession, d: str) -> DataFrame:
    ordered = ranges(spark, d).withColumn("place", F.struct("start_line", "k"))
    return entities.predecessors(ordered, ["file"], "place", "k").select("file", "k", "predecessor")


@query("SELECT l_orderkey AS key, max_by(l_partkey, (l_linenumber, l_partkey)) AS content FROM lineitem GROUP BY l_orderkey")
def region_last_wins(spark: SparkSession, d: str) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey").alias("place")
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), place, F.col("l_partkey").alias("content"))
    return entities.last_content(rows, ["key"], "place", "content")


@query("""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) || chr(10) AS content FROM r GROUP BY doc_id""")
def reconstruct_text(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return entities.join_lines(lines, ["doc_id"], "n", "line")


# ---- lines and texts

LINES_SQL = "CASE WHEN {0} = '' THEN [] WHEN {0} LIKE '%' || chr(10) THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
IMPORT_SQL = "(NOT (starts_with({0}, ' ') OR starts_with({0}, chr(9))) AND (" + " OR ".join(f"starts_with(ltrim({{0}}), '{p}')" for p in text.IMPORT_PREFIXES) + " OR (starts_with({0}, 'const ') AND contains({0}, 'require('))))"


@query(f"WITH {fx.TEXT_VERSIONS_SQL} SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: {IMPORT_SQL.format('x')})) AS n_imports FROM (SELECT doc_id, {LINES_SQL.format('ours')} AS l FROM versions)")
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    v = fx.text_versions(spark, d).select("doc_id", text.lines(F.col("ours")).alias("l"))
    return v.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", text.is_import_line)).cast("long").alias("n_imports"))


@query(f"WITH {fx.TEXT_VERSIONS_SQL} SELECT doc_id, 2 * len(list_filter(l, lambda x: {IMPORT_SQL.format('x')})) > len(list_filter(l, lambda x: trim(x) <> '')) AS import_region FROM (SELECT doc_id, {LINES_SQL.format('theirs')} AS l FROM versions)")
def import_region(spark: SparkSession, d: str) -> DataFrame:
    return fx.text_versions(spark, d).select("doc_id", text.is_import_region(F.col("theirs")).alias("import_region"))


@query(rf"""WITH {fx.TEXT_VERSIONS_SQL}, l AS (
  SELECT doc_id, {LINES_SQL.format('base')} AS bl, {LINES_SQL.format('ours')} AS ol, {LINES_SQL.format('theirs')} AS tl, ours FROM versions),
i AS (SELECT *, list_filter(bl, lambda x: {IMPORT_SQL.format('x')}) AS b, list_filter(ol, lambda x: {IMPORT_SQL.format('x')}) AS o, list_filter(tl, lambda x: {IMPORT_SQL.format('x')}) AS t FROM l),
k AS (SELECT *, list_filter(t, lambda x: NOT list_contains(b, x) AND NOT list_contains(o, x)) AS added,
  list_filter(ol, lambda x: NOT ({IMPORT_SQL.format('x')} AND list_contains(b, x) AND NOT list_contains(t, x))) AS kept FROM i),
m AS (SELECT *, coalesce(list_max(list_filter(list_transform(kept, lambda x, n: CASE WHEN {IMPORT_SQL.format('x')} THEN n END), lambda n: n IS NOT NULL)), 0) AS last FROM k),
j AS (SELECT doc_id, ours, array_to_string(list_concat(list_concat(kept[1:last], added), kept[last + 1:]), chr(10)) AS x FROM m)
SELECT doc_id, md5(x || repeat(chr(10), greatest((length(ours) - length(rtrim(ours, chr(10)))) - (length(x) - length(rtrim(x, chr(10)))), 0))) AS merged_md5 FROM j""")
def import_merge(spark: SparkSession, d: str) -> DataFrame:
    v = fx.text_versions(spark, d)
    return v.select("doc_id", F.md5(text.merge_imports(F.col("base"), F.col("ours"), F.col("theirs")).cast("binary")).alias("merged_md5"))


@query(f"""WITH {fx.TEXT_VERSIONS_SQL} SELECT doc_id, list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: x <> '') = list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS whitespace_only
FROM (SELECT doc_id, base AS a, CASE WHEN doc_id % 3 = 0 THEN replace(base, chr(10), '  ' || chr(10) || chr(10)) ELSE ours END AS b FROM versions)""")
def whitespace_only(spark: SparkSession, d: str) -> DataFrame:
    v = fx.text_versions(spark, d)
    other = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("base"), F.lit("\n"), F.lit("  \n\n"))).otherwise(F.col("ours"))
    return v.select("doc_id", text.is_whitespace_only_diff(F.col("base"), other).alias("whitespace_only"))


@query("""WITH a AS (SELECT p_partkey AS k, ['@a' || (p_partkey % 3), '@b', '@c' || (p_partkey % 2)] AS b, ['@a' || (p_partkey % 3), '@o' || (p_partkey % 5), '@c' || (p_partkey % 2)] AS o,
  ['@t' || (p_partkey % 4), '@b', '@c' || (p_partkey % 2)] AS t FROM part)
SELECT k, array_to_string(list_concat(list_concat(list_filter(b, lambda x: list_contains(o, x) AND list_contains(t, x)), list_filter(o, lambda x: NOT list_contains(b, x))),
  list_filter(t, lambda x: NOT list_contains(b, x) AND NOT list_contains(o, x))), ' ') AS decorators FROM a""")
def decorator_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    named = lambda mark, m: F.concat(F.lit(mark), (k % m).cast("string"))
    body = F.lit("def f():\n  pass\n")
    content = lambda *x: F.concat(F.concat_ws("\n", *x), F.lit("\n"), body)
    b, o, t = content(named("@a", 3), F.lit("@b"), named("@c", 2)), content(named("@a", 3), named("@o", 5), named("@c", 2)), content(named("@t", 4), F.lit("@b"), named("@c", 2))
    sides = [text.split_decorators(x)["decorators"] for x in (b, o, t)]
    return fx.table(spark, d, "part").select(k.alias("k"), F.array_join(text.merge_decorators(*sides), " ").alias("decorators"))


@query(f"""WITH r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {LINES_SQL.format('text')} AS l FROM documents)),
p AS (SELECT *, lag(line) OVER w AS b1, lag(line, 2) OVER w AS b2 FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS x FROM p WHERE CASE WHEN trim(line) = '' THEN NOT coalesce(trim(b1) = '' AND trim(b2) = '', false) ELSE b1 IS NULL OR line <> b1 END GROUP BY doc_id)
SELECT doc_id, md5(coalesce(x, '') || CASE WHEN ends_with(text, chr(10)) AND NOT ends_with(coalesce(x, ''), chr(10)) THEN chr(10) ELSE '' END) AS cleaned_md5 FROM documents LEFT JOIN k USING (doc_id)""")
def dedupe_lines(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.cleanup(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, chr(10), repeat(chr(10), CAST(1 + doc_id % 5 AS BIGINT))), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS capped_md5 FROM documents".replace("\\\\", "\\"))
def blank_run_cap(spark: SparkSession, d: str) -> DataFrame:
    spread = F.replace(F.col("text"), F.lit("\n"), F.repeat(F.lit("\n"), (1 + F.col("doc_id") % 5).cast("int")))
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.cap_blank_runs(spread).cast("binary")).alias("capped_md5"))


COMMENT_SQL = "(" + " OR ".join("starts_with(trim({0}), '" + p.replace("'", "''") + "')" for p in text.COMMENT_PREFIXES) + ")"
CHANGE_SQL = "{x} <> base AND (({h} AND {c}) OR ({r} AND {s})) AS {n}_t, {x} <> base AND {h} AND NOT {c} AS {n}_s, {x} <> base AND {r} AND NOT {s} AS {n}_f"


def _change(side: str) -> str:
    head, comment = f"coalesce(bl[1], '') <> coalesce({side}l[1], '')", f"({COMMENT_SQL.format('coalesce(bl[1], chr(32))')} OR {COMMENT_SQL.format(f'coalesce({side}l[1], chr(32))')})"
    code = "list_filter({0}[2:], lambda y: NOT " + COMMENT_SQL.format("y") + ")"
    return CHANGE_SQL.format(x=side, h=head, c=comment, r=f"bl[2:] <> {side}l[2:]", s=f"{code.format('bl')} = {code.format(side + 'l')}", n=side)


# the first line is the signature and must differ per side for S to occur: the import block is left out
CLASSIFY_SQL = f"""v AS (SELECT p_partkey AS doc_id, 'f(' || (p_partkey % 3) || ')' || chr(10) || '// c' || chr(10) || 'x = ' || p_size AS base,
  'f(' || (CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 ELSE 9 END) || ')' || chr(10) || '// c' || (p_partkey % 4) || chr(10) || 'x = ' || p_size AS ours,
  'f(' || (p_partkey % 3) || ')' || chr(10) || '// c' || chr(10) || 'x = ' || (CASE WHEN p_partkey % 5 < 3 THEN p_size ELSE 99 END) AS theirs FROM part),
l AS (SELECT *, {LINES_SQL.format('base')} AS bl, {LINES_SQL.format('ours')} AS oursl, {LINES_SQL.format('theirs')} AS theirsl FROM v),
c AS (SELECT doc_id, base, ours, theirs, {_change('ours')}, {_change('theirs')} FROM l),
labelled AS (SELECT doc_id, ours, theirs, coalesce(nullif(concat_ws('+', CASE WHEN ours_t OR theirs_t THEN 'T' END, CASE WHEN ours_s OR theirs_s THEN 'S' END, CASE WHEN ours_f OR theirs_f THEN 'F' END), ''), '?') AS complexity FROM c)"""


def snippets(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    made = lambda sig, c, x: F.concat(F.lit("f("), sig.cast("string"), F.lit(")\n// c"), c, F.lit("\nx = "), x)
    return fx.table(spark, d, "part").select(
        k.alias("doc_id"),
        made(k % 3, F.lit(""), size).alias("base"),
        made(F.when(k % 2 == 0, k % 3).otherwise(9), (k % 4).cast("string"), size).alias("ours"),
        made(k % 3, F.lit(""), F.when(k % 5 < 3, size).otherwise("99")).alias("theirs"),
    )


@query(f"WITH {CLASSIFY_SQL} SELECT doc_id, complexity FROM labelled")
def classify_conflict(spark: SparkSession, d: str) -> DataFrame:
    return snippets(spark, d).select("doc_id", text.classify_conflict(F.col("base"), F.col("ours"), F.col("theirs")).alias("complexity"))


def _case(at: int) -> str:
    return "CASE complexity " + " ".join(f"WHEN '{r[0]}' THEN '{r[at]}'" for r in text.COMPLEXITY) + " END"


MARKERS_SQL = f"""{CLASSIFY_SQL}, titled AS (SELECT *, 'function `f' || doc_id || '` (' || complexity || ', confidence: ' || {_case(1)} || ')' AS title, {_case(2)} AS hint FROM labelled),
marked AS (SELECT doc_id, complexity, hint, ours, theirs, '<<<<<<< ours — ' || title || chr(10) || '// hint: ' || hint || chr(10) || ours || chr(10) || '=======' || chr(10) || theirs || chr(10) || '>>>>>>> theirs — ' || title || chr(10) AS markers FROM titled)"""


def marked_snippets(spark: SparkSession, d: str) -> DataFrame:
    label = snippets(spark, d).withColumn("complexity", text.classify_conflict(F.col("base"), F.col("ours"), F.col("theirs")))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return label.select("doc_id", "complexity", text.conflict_markers(F.lit("function"), name, F.col("complexity"), F.col("ours"), F.col("theirs")).alias("markers"))


@query(f"WITH {MARKERS_SQL} SELECT doc_id, markers FROM marked")
def conflict_markers(spark: SparkSession, d: str) -> DataFrame:
    return marked_snippets(spark, d).select("doc_id", "markers")


@query(f"WITH {MARKERS_SQL} SELECT doc_id, 'f' || doc_id AS entity_name, 'function' AS entity_kind, complexity, {_case(1)} AS confidence, hint, ours, theirs FROM marked")
def parse_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = marked_snippets(spark, d).select("doc_id", "markers").lateralJoin(ParseConflicts(F.col("markers").outer()))
    return found.select("doc_id", "entity_name", "entity_kind", "complexity", "confidence", "hint", "ours", "theirs")


@query(f"WITH {MARKERS_SQL} SELECT doc_id, CAST(1 + doc_id % 3 AS BIGINT) AS n FROM marked")
def marker_count(spark: SparkSession, d: str) -> DataFrame:
    many = F.repeat(F.col("markers"), (1 + F.col("doc_id") % 3).cast("int"))
    return marked_snippets(spark, d).select("doc_id", text.marker_count(many).cast("long").alias("n"))


@query("""SELECT p_partkey AS k, right(p, 3) <> 'zzz' AND p SIMILAR TO '.*(json|md)' AS plain, CASE WHEN p_partkey % 4 = 0 THEN true ELSE false END AS binary_text,
  CASE WHEN starts_with(p, '/repo/') THEN substr(p, 7) ELSE p END AS relative, replace(p, '/', '_') AS folder
FROM (SELECT p_partkey, '/repo' || (p_partkey % 2) || '/a/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.py' ELSE '.md' END AS q,
  CASE WHEN p_partkey % 2 = 0 THEN '/repo/a/' ELSE '/other/a/' END || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.py' ELSE '.md' END AS p FROM part)""")
def path_guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ending = F.when(k % 3 == 0, ".json").when(k % 3 == 1, ".py").otherwise(".md")
    path = F.concat(F.when(k % 2 == 0, F.lit("/repo/a/")).otherwise(F.lit("/other/a/")), k.cast("string"), ending)
    content = F.concat(F.col("p_name"), F.when(k % 4 == 0, F.lit("\0x")).otherwise(F.lit("y")))
    return fx.table(spark, d, "part").select(k.alias("k"), text.is_plain_format(path).alias("plain"), text.is_binary(content).alias("binary_text"), text.relative_path(path, F.lit("/repo")).alias("relative"), text.path_as_directory(path).alias("folder"))


@query(f"""WITH {fx.ORDER_VERSIONS_SQL}, c AS (SELECT k, resolution NOT LIKE 'conflict%' AS ours_clean, os IS NOT DISTINCT FROM ts OR os IS NOT DISTINCT FROM bs OR ts IS NOT DISTINCT FROM bs AS line_clean, k % 3 = 0 AS human FROM classed)
SELECT count(*) AS tested, count(*) FILTER (ours_clean AND line_clean) AS both_clean, count(*) FILTER (ours_clean AND NOT line_clean) AS wins, count(*) FILTER (NOT ours_clean AND NOT line_clean) AS both_conflict,
  count(*) FILTER (NOT ours_clean AND line_clean) AS regressions, count(*) FILTER (ours_clean AND NOT line_clean AND human) AS matches_human,
  round(coalesce(count(*) FILTER (ours_clean AND NOT line_clean) / nullif(count(*) FILTER (NOT line_clean), 0), 0), 6) AS resolution_rate,
  round(coalesce(count(*) FILTER (ours_clean AND NOT line_clean AND human) / nullif(count(*) FILTER (ours_clean AND NOT line_clean), 0), 0), 6) AS human_match_rate FROM c""")
def bench_matrix(spark: SparkSession, d: str) -> DataFrame:
    a = aligned_orders(spark, d).withColumn("ours_clean", ~F.startswith(align.resolution(VALUES), F.lit("conflict")))
    o, t, b = F.col("ours_status"), F.col("theirs_status"), F.col("base_status")
    cases = a.select("ours_clean", (o.eqNullSafe(t) | o.eqNullSafe(b) | t.eqNullSafe(b)).alias("line_clean"), (F.col("k") % 3 == 0).alias("matches_human"))
    return bench.matrix(cases).withColumns({c: F.round(c, 6) for c in ("resolution_rate", "human_match_rate")})


@query("""WITH v AS (SELECT p_partkey AS k, p_name AS n, p_partkey % 4 AS m FROM part)
SELECT k, CASE m WHEN 0 THEN 'both modified' WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 'modified in ours, deleted in theirs' ELSE 'deleted in ours, modified in theirs' END
    WHEN 2 THEN 'both added' ELSE 'both renamed: ' || chr(39) || n || chr(39) || ' → ours ' || chr(39) || n || '1' || chr(39) || ', theirs ' || chr(39) || n || '2' || chr(39) END AS kind,
  CASE WHEN m = 0 THEN 'warning: merged output for `' || n || '` failed to parse — result may be syntactically broken'
    ELSE 'warning: function `' || n || '` was modified and ' || CASE WHEN m = 1 THEN 'references' ELSE 'is used by' END || ' class `C` which was also modified' END AS warning,
  substr(md5(n), 1, 8) AS short, rtrim(n) || chr(10) || 'x' AS stripped, m = 1 AS container FROM v""")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    k, n, m = F.col("p_partkey"), F.col("p_name"), F.col("p_partkey") % 4
    kind = F.when(m == 0, "both_modified").when(m == 1, "modify_delete").when(m == 2, "both_added").otherwise("rename_rename")
    warned = F.when(m == 0, "parse_failed_after_merge").when(m == 1, "dependency_also_modified").otherwise("dependent_also_modified")
    entity = F.when(m == 1, F.lit("impl_item")).otherwise(F.lit("function"))
    return fx.table(spark, d, "part").select(
        k.alias("k"),
        text.conflict_kind_text(kind, k % 8 == 1, n, F.concat(n, F.lit("1")), F.concat(n, F.lit("2"))).alias("kind"),
        graph.warning_text(warned, F.lit("function"), n, F.lit("class"), F.lit("C")).alias("warning"),
        text.short_hash(F.md5(n.cast("binary"))).alias("short"),
        text.right_stripped(F.concat(n, F.lit("  \t\nx \n\n"))).alias("stripped"),
        text.is_container_type(entity).alias("container"),
    )


@query(f"""WITH {fx.TEXT_VERSIONS_SQL}, l AS (SELECT doc_id, {LINES_SQL.format('base')} AS a, {LINES_SQL.format('ours')} AS b FROM versions),
n AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line FROM l), p AS (SELECT doc_id, line, coalesce(a[line], '') AS x, coalesce(b[line], '') AS y FROM n)
SELECT doc_id, CAST(line AS INTEGER) AS line, x AS base_line, y AS ours_line FROM p WHERE rtrim(x) <> rtrim(y)""")
def inline_diff(spark: SparkSession, d: str) -> DataFrame:
    v = fx.text_versions(spark, d).select("doc_id", F.explode(text.differing_lines(F.col("base"), F.col("ours"))).alias("d"))
    return v.select("doc_id", "d.line", F.col("d.left").alias("base_line"), F.col("d.right").alias("ours_line"))


# ---- whole files

def source_files(spark: SparkSession, d: str) -> DataFrame:
    """A Python-like file for each part, with edits on both sides."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    f = lambda name, body: F.concat(F.lit("def "), F.lit(name), F.lit("(x):\n    y = x\n    return "), body, F.lit("\n\n\n"))
    head = F.lit("import os\nimport sys\n\n\n")
    base = F.concat(head, f("a", size), f("b", size), f("c", size))
    ours = F.concat(F.lit("import os\nimport re\nimport sys\n\n\n"), f("a", F.lit("1")), f("b", size), f("c", F.when(k % 2 == 0, size).otherwise("7")), f("d", size))
    theirs = F.concat(F.lit("import json\nimport os\nimport sys\n\n\n"), f("a", size), f("e", F.lit("5")), f("b", F.lit("2")), F.when(k % 3 == 0, F.lit("")).otherwise(f("c", F.when(k % 5 == 0, "8").otherwise(size))))
    return fx.table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("file_path"), base.alias("base"), ours.alias("ours"), theirs.alias("theirs"))


def _function(name: str, body: str) -> str:
    return f"'def {name}(x):' || chr(10) || '    y = x' || chr(10) || '    return ' || {body} || repeat(chr(10), 3)"


#: What becomes of each file: a, b, d and e merge always; c may be edited by ours (to 7) and edited (to 8), deleted or, where its
#: body is that of the new function e, renamed by theirs. Where both edit c, entities conflict and the line merge does not.
MERGES_SQL = f"""edits AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 2 = 1 AND p_size <> 7 AS mine, p_partkey % 3 = 0 AS gone,
  p_partkey % 3 <> 0 AND p_partkey % 5 = 0 AND p_size <> 8 AS other FROM part),
kinds AS (SELECT *, gone AND s = 5 AS renamed, mine AND gone AND s <> 5 AS conflict, mine AND other AS by_lines FROM edits),
merged AS (SELECT *,
  CASE WHEN by_lines THEN 'import json' || chr(10) || 'import os' || chr(10) || 'import re' || chr(10) || 'import sys'
       ELSE 'import os' || chr(10) || 'import re' || chr(10) || 'import sys' || chr(10) || 'import json' END || repeat(chr(10), 3)
  || {_function('a', "'1'")} || CASE WHEN renamed THEN '' ELSE {_function('e', "'5'")} END || {_function('b', "'2'")}
  || CASE WHEN conflict THEN '<<<<<<< ours — function `c`' || chr(10) || rtrim({_function('c', "'7'")}, chr(10)) || chr(10) || '=======' || chr(10) || '>>>>>>> theirs — function `c`' || chr(10)
          WHEN renamed THEN {_function('e', "CASE WHEN mine THEN '7' ELSE '5' END")} WHEN gone THEN '' WHEN mine THEN {_function('c', "'7'")} WHEN other THEN {_function('c', "'8'")} ELSE {_function('c', 's')} END
  || {_function('d', "CASE WHEN by_lines THEN '8' ELSE CAST(s AS VARCHAR) END")} AS content,
  NOT conflict AS is_clean, CASE WHEN conflict THEN 'conflict' WHEN by_lines THEN 'medium' WHEN renamed AND mine THEN 'high' ELSE 'very_high' END AS confidence,
  CAST(NOT by_lines AND renamed AND mine AS INTEGER) AS both_changed_merged FROM kinds)"""


@query(f"""WITH {MERGES_SQL}, n AS (SELECT *, CAST(NOT by_lines AS INTEGER) AS e, NOT (conflict OR gone OR mine OR other) AS c_same FROM merged)
SELECT k, content, is_clean, confidence, CAST(conflict AS INTEGER) AS n_conflicts,
  e * (CAST(s = 1 AS INTEGER) + CAST(s = 2 AS INTEGER) + CAST(c_same AS INTEGER)) AS unchanged,
  e * (CAST(s <> 1 AS INTEGER) + CAST(mine AND NOT gone AS INTEGER)) AS ours_only,
  e * (CAST(s <> 2 AS INTEGER) + CAST((other AND NOT mine) OR (renamed AND NOT mine) AS INTEGER)) AS theirs_only,
  both_changed_merged, e * CAST(conflict AS INTEGER) AS conflicted, e AS added_ours, e * CAST(NOT renamed AS INTEGER) AS added_theirs,
  e * CAST(gone AND NOT mine AND NOT renamed AS INTEGER) AS deleted, both_changed_merged AS via_lines, 0 AS via_inner, by_lines AS used_fallback FROM n""")
def merge_files(spark: SparkSession, d: str) -> DataFrame:
    merged = files.merge_table(source_files(spark, d), ["k"])
    return merged.select("k", "content", "is_clean", "confidence", F.size("conflicts").alias("n_conflicts"), "stats.*")


@query(f"""WITH {MERGES_SQL} SELECT count(*) AS files, count(*) FILTER (is_clean) AS clean, count(*) FILTER (NOT is_clean) AS conflicted, CAST(sum(both_changed_merged) AS BIGINT) AS auto_merged,
  CASE WHEN bool_or(confidence = 'conflict') THEN 'conflict' WHEN bool_or(confidence = 'medium') THEN 'medium' WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'very_high' END AS confidence FROM merged""")
def merge_preview(spark: SparkSession, d: str) -> DataFrame:
    return files.preview(files.merge_table(source_files(spark, d), ["k"]))


@query()
def line_merge(spark: SparkSession, d: str) -> DataFrame:
    return files.line_merge_table(fx.text_versions(spark, d), ["doc_id"])


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, len(l) AS n, l[1] AS x, l[-1] AS y, CASE WHEN len(l) > 2 THEN array_to_string(l[2:-2], chr(10)) END AS middle FROM l)
SELECT doc_id, CAST(n < 3 AS INTEGER) AS n_conflicts, md5(CASE WHEN n > 2 THEN x || ' // o' || chr(10) || middle || chr(10) || y || ' # t'
  ELSE '<<<<<<< ours' || chr(10) || x || ' // o' || chr(10) || CASE WHEN n = 2 AND y <> '' THEN y || chr(10) ELSE '' END
    || '=======' || chr(10) || x || CASE WHEN n = 2 THEN chr(10) || y ELSE '' END || ' # t' || chr(10) || '>>>>>>> theirs' || chr(10) END) AS merged_md5 FROM s""")
def line_merge_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ours edits the first line, theirs the last: clean where a line stands between them."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("base"))
    ours = F.regexp_replace("base", r"\A([^\n]*)", "$1 // o")
    found = files.line_merge_table(docs.withColumns({"ours": ours, "theirs": F.concat("base", F.lit(" # t"))}), ["doc_id"])
    return found.select("doc_id", "n_conflicts", F.md5(F.col("merged").cast("binary")).alias("merged_md5"))


@query("""WITH f AS (SELECT 'src/m' || p_partkey || '.py' AS file_path, unnest([0, 1, 2, 3]) AS ord, p_size AS s, p_partkey % 2 = 1 AS odd FROM part),
e AS (SELECT file_path, ord, substr('abcd', ord + 1, 1) AS name, CASE WHEN ord = 0 THEN '1' WHEN ord = 2 AND odd THEN '7' ELSE CAST(s AS VARCHAR) END AS body FROM f),
t AS (SELECT *, '(x):' || chr(10) || '    y = x' || chr(10) || '    return ' || body AS rest FROM e)
SELECT file_path, CAST(ord AS INTEGER) AS ord, file_path || '::function::' || name AS entity_id, name, 'function' AS entity_type, CAST(NULL AS VARCHAR) AS parent_id, CAST(6 + 5 * ord AS INTEGER) AS start_line,
  CAST(8 + 5 * ord AS INTEGER) AS end_line, 'def ' || name || rest AS content, md5('def ' || name || rest) AS content_hash, md5('def __ENTITY__' || rest) AS body_hash FROM t""")
def parse_entities(spark: SparkSession, d: str) -> DataFrame:
    return files.entity_table(source_files(spark, d), "file_path", "ours").drop("structural_hash")


@query("""WITH f AS (SELECT 'src/m' || p_partkey || '.py' AS file_path, unnest(range(0, 9)) AS ord, p_size AS s, p_partkey % 2 = 1 AS odd FROM part),
e AS (SELECT *, substr('abcd', (ord + 1) // 2, 1) AS name, CASE WHEN ord = 1 THEN '1' WHEN ord = 5 AND odd THEN '7' ELSE CAST(s AS VARCHAR) END AS body FROM f)
SELECT file_path, CAST(ord AS INTEGER) AS ord, CASE WHEN ord % 2 = 1 THEN 'entity' ELSE 'gap' END AS kind,
  CASE WHEN ord = 0 THEN 'after:start' WHEN ord % 2 = 0 THEN 'after:' ELSE '' END || CASE WHEN ord > 0 THEN file_path || '::function::' || name ELSE '' END AS key,
  CASE WHEN ord = 0 THEN 'import os' || chr(10) || 'import re' || chr(10) || 'import sys' || repeat(chr(10), 3) WHEN ord % 2 = 0 THEN repeat(chr(10), 2)
    ELSE 'def ' || name || '(x):' || chr(10) || '    y = x' || chr(10) || '    return ' || body || chr(10) END AS content FROM e""")
def extract_regions(spark: SparkSession, d: str) -> DataFrame:
    return files.region_table(source_files(spark, d), "file_path", "ours")


@query("""SELECT doc_id, md5(coalesce(text, '') || '{a;}') AS collapsed_md5, true AS on_lines FROM documents""")
def separator_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A block after each text goes to lines of its own and comes back; what stands in strings and comments stays."""
    made = fx.table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("{a;}")).alias("text"))
    found = files.separators(made, "doc_id", "text")
    return found.select("doc_id", F.md5(F.col("collapsed").cast("binary")).alias("collapsed_md5"), (F.length("expanded") >= F.length("collapsed")).alias("on_lines"))


@query(f"""WITH RECURSIVE {fx.LOG_SQL}, {CLAIMS_SQL}, e AS (SELECT DISTINCT entity_id, CAST(substr(entity_id, 7) AS BIGINT) % 7 AS file FROM log)
SELECT file, entity_id, claimed_by, v.version, v.last_modified_by FROM e LEFT JOIN claims USING (entity_id)
LEFT JOIN (SELECT entity_id, count(*) AS version, max_by(agent_id, (ts, seq)) AS last_modified_by FROM log WHERE op = 'modify' GROUP BY entity_id) v USING (entity_id)""")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    log = fx.operation_log(spark, d)
    held = log.select("entity_id").distinct().withColumn("file", F.substring("entity_id", 7, 20).cast("long") % 7)
    return state.file_status(held, log).select("file", "entity_id", "claimed_by", "version", "last_modified_by")


# ---- graphs

@query(f"WITH {fx.GRAPH_SQL} SELECT src, dst FROM edges WHERE src IN ('s1', 's2', 'p90')")
def graph_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(fx.part_graph(spark, d), spark.createDataFrame([("s1",), ("s2",), ("p90",)], "id string")).select("src", "dst")


@query(f"WITH {fx.GRAPH_SQL} SELECT src, dst FROM edges WHERE dst IN ('p3', 'p40')")
def graph_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependents(fx.part_graph(spark, d), spark.createDataFrame([("p3",), ("p40",)], "id string"))


@query(f"""WITH RECURSIVE {fx.GRAPH_SQL}, reach AS (SELECT 'p5' AS id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM reach r JOIN edges e ON e.dst = r.id)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY id HAVING min(depth) > 0""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(fx.part_graph(spark, d), spark.createDataFrame([("p5",)], "id string"))


@query(f"WITH {fx.GRAPH_SQL}, m AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size % 3 = 0 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m) AND src <> dst")
def validate_warnings(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.table(spark, d, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    suppliers = fx.table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.validate(fx.part_graph(spark, d), parts.union(suppliers))


# ---- state

@query(f"WITH {fx.LOG_SQL} SELECT ts, seq, agent_id, entity_id, op FROM log WHERE op IN ('claim', 'release', 'modify')")
def op_log(spark: SparkSession, d: str) -> DataFrame:
    return fx.operation_log(spark, d).filter(F.col("op").isin("claim", "release", "modify")).drop("payload")


@query(f"""WITH {fx.LOG_SQL} SELECT entity_id, count(*) AS version, max_by(agent_id, (ts, seq)) AS last_modified_by, max(ts) AS last_modified_at, max_by(payload, (ts, seq)) AS content_hash
FROM log WHERE op = 'modify' GROUP BY entity_id""")
def entity_status(spark: SparkSession, d: str) -> DataFrame:
    return state.entity_status(fx.operation_log(spark, d))


AGENTS_SQL = f"""{fx.LOG_SQL}, known AS (SELECT agent_id, min((ts, seq)) AS since FROM log WHERE op = 'register' GROUP BY agent_id),
seen AS (SELECT l.*, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, seq DESC) AS rn FROM log l JOIN known USING (agent_id) WHERE op IN ('register', 'heartbeat') AND (ts, seq) >= since),
agents AS (SELECT agent_id, ts AS last_seen, CASE WHEN op = 'heartbeat' THEN entity_id ELSE '' END AS working_on FROM seen WHERE rn = 1)"""
NOW, TIMEOUT = 1706659200000, 86400000


@query(f"WITH {AGENTS_SQL} SELECT agent_id, last_seen, working_on FROM agents")
def agent_status(spark: SparkSession, d: str) -> DataFrame:
    return state.agent_status(fx.operation_log(spark, d)).withColumn("working_on", F.array_join("working_on", ","))


@query(f"WITH {AGENTS_SQL} SELECT agent_id, last_seen FROM agents WHERE {NOW} - last_seen > {TIMEOUT}")
def stale_agents(spark: SparkSession, d: str) -> DataFrame:
    return state.stale_agents(state.agent_status(fx.operation_log(spark, d)), NOW, TIMEOUT)


@query(f"WITH RECURSIVE {fx.LOG_SQL}, {CLAIMS_SQL} SELECT entity_id, ts, seq, agent_id, op, outcome, claimed_by FROM folded")
def claim_fold(spark: SparkSession, d: str) -> DataFrame:
    return state.fold_claims(fx.operation_log(spark, d))


@query(f"WITH RECURSIVE {fx.LOG_SQL}, {CLAIMS_SQL} SELECT entity_id, claimed_by FROM claims")
def current_claims(spark: SparkSession, d: str) -> DataFrame:
    return state.current_claims(fx.operation_log(spark, d))


@query(f"""WITH RECURSIVE {AGENTS_SQL}, {CLAIMS_SQL}
SELECT agent_id, CASE WHEN {NOW} - last_seen > {TIMEOUT} THEN 'stale' ELSE 'active' END AS status, coalesce(n, 0) AS claims
FROM agents LEFT JOIN (SELECT claimed_by AS agent_id, count(*) AS n FROM claims WHERE claimed_by NOT IN (SELECT agent_id FROM agents WHERE {NOW} - last_seen > {TIMEOUT}) GROUP BY claimed_by) USING (agent_id)""")
def cleanup(spark: SparkSession, d: str) -> DataFrame:
    agents, claims = state.cleaned_up(fx.operation_log(spark, d), NOW, TIMEOUT)
    held = claims.groupBy(F.col("claimed_by").alias("agent_id")).agg(F.count(F.lit(1)).alias("n"))
    return agents.join(held, "agent_id", "left").select("agent_id", "status", F.coalesce("n", F.lit(0)).alias("claims"))


@query(f"""WITH RECURSIVE {AGENTS_SQL}, {CLAIMS_SQL}, w AS (
  SELECT working_on AS entity_id, agent_id FROM agents WHERE working_on <> '' AND {NOW} - last_seen <= {TIMEOUT}
  UNION SELECT entity_id, claimed_by FROM claims WHERE claimed_by NOT IN (SELECT agent_id FROM agents WHERE {NOW} - last_seen > {TIMEOUT}))
SELECT entity_id, array_to_string(list_sort(list(agent_id)), ',') AS agents, count(*) AS n_agents FROM w
WHERE entity_id IN (SELECT entity_id FROM log WHERE op = 'modify') GROUP BY entity_id HAVING count(*) > 1""")
def potential_conflicts(spark: SparkSession, d: str) -> DataFrame:
    log = fx.operation_log(spark, d)
    found = state.potential_conflicts(*state.cleaned_up(log, NOW, TIMEOUT), state.entity_status(log))
    return found.select("entity_id", F.array_join("agents", ",").alias("agents"), "n_agents")


@query("""WITH s AS (SELECT 'e' || c_custkey AS entity_id, c_name AS name, 'function' AS entity_type, 'f' || c_nationkey AS file_path, md5(c_name) AS content_hash, CASE WHEN c_custkey % 4 = 0 THEN 'agent' END AS claimed_by, 1 + c_custkey % 3 AS version FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT 'e' || c_custkey AS entity_id, c_name || '!' AS name, 'class' AS entity_type, 'f' || c_nationkey AS file_path, md5(c_name || '!') AS content_hash FROM customer WHERE c_custkey % 3 = 0)
SELECT entity_id, coalesce(n.name, s.name) AS name, coalesce(n.entity_type, s.entity_type) AS entity_type, coalesce(n.file_path, s.file_path) AS file_path, coalesce(n.content_hash, s.content_hash) AS content_hash, claimed_by, coalesce(version, 0) AS version FROM s FULL JOIN n USING (entity_id)""")
def sync_upsert(spark: SparkSession, d: str) -> DataFrame:
    k, name, file = F.col("c_custkey"), F.col("c_name"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_path")
    customer, entity = fx.table(spark, d, "customer"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("entity_id")
    old = customer.filter(k % 2 == 0).select(entity, name.alias("name"), F.lit("function").alias("entity_type"), file, F.md5(name.cast("binary")).alias("content_hash"), F.when(k % 4 == 0, "agent").alias("claimed_by"), (1 + k % 3).alias("version"))
    new = F.concat(name, F.lit("!"))
    incoming = customer.filter(k % 3 == 0).select(entity, new.alias("name"), F.lit("class").alias("entity_type"), file, F.md5(new.cast("binary")).alias("content_hash"))
    return state.upsert(old, incoming)


@query(f"""WITH {fx.GRAPH_SQL}, c AS (SELECT 's' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'me' ELSE 'other' END AS claimed_by FROM supplier)
SELECT entity_id, relation, claimed_by FROM (SELECT dst AS entity_id, 'dependency' AS relation FROM edges WHERE src = 'p10' UNION ALL SELECT src, 'dependent' FROM edges WHERE dst = 'p10') JOIN c USING (entity_id) WHERE claimed_by <> 'me'""")
def claim_warnings(spark: SparkSession, d: str) -> DataFrame:
    claims = fx.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, "me").otherwise("other").alias("claimed_by"))
    return state.claim_warnings(claims, fx.part_graph(spark, d), "me", "p10")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return merge3_rows_stats(spark, d)
