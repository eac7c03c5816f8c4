"""One function per question an agent or tool asks; each returns a DataFrame.

A Workspace holds tables: files (path, content) and the operation log. Writes
append rows to the log; everything else is a fold over it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.functions.markers import ParseConflicts
from trifold.operators import entities, files, graph, state
from trifold.sources import git

LOG = "ts long, seq long, agent_id string, entity_id string, op string, payload string"


@dataclass
class Workspace:
    spark: SparkSession
    files: DataFrame
    log_path: str | None = None
    _rows: list = None

    def log(self) -> DataFrame:
        """The log in storage, and what this workspace appended without a path."""
        own = self.spark.createDataFrame(self._rows or [], LOG)
        if self.log_path is None:
            return own
        try:
            return self.spark.read.schema(LOG).parquet(self.log_path).unionByName(own)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return own
            raise

    def append(self, ts: int, agent_id: str, entity_ids: list[str | None], op: str, payload: str | None = None) -> None:
        """One operation: a row for each entity, all with one seq, which grows with the real time."""
        seq = time.time_ns()
        rows = [(ts, seq, agent_id, entity, op, payload) for entity in entity_ids]
        if self.log_path is None:
            self._rows = (self._rows or []) + rows
        else:
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.log_path)

    def entities(self) -> DataFrame:
        return files.entity_table(self.files, "path", "content")

    def edges(self) -> DataFrame:
        return graph.build_edges(self.entities())


def extract_entities(w: Workspace, path: str) -> DataFrame:
    return files.entity_table(w.files.filter(F.col("path") == path), "path", "content")


def resolve(w: Workspace, path: str, name: str) -> str | None:
    """The id of the first entity of that name in the file."""
    row = extract_entities(w, path).filter(F.col("name") == name).orderBy("ord").select("entity_id").first()
    return row[0] if row else None


def claim_entity(w: Workspace, agent_id: str, path: str, name: str, ts: int) -> DataFrame:
    """The outcome (not_found, claimed, already_...) and, as `warnings`, graph neighbours that others hold."""
    entity = resolve(w, path, name)
    if entity is None:
        return w.spark.createDataFrame([(None, "not_found", None, [])], "entity_id string, outcome string, claimed_by string, warnings array<string>")
    w.append(ts, agent_id, [entity], "claim")
    last = state.fold_claims(w.log()).filter((F.col("entity_id") == entity) & (F.col("agent_id") == agent_id)).groupBy("entity_id").agg(F.max_by("outcome", F.struct("ts", "seq")).alias("outcome"), F.max_by("claimed_by", F.struct("ts", "seq")).alias("claimed_by"))
    near = state.claim_warnings(state.current_claims(w.log()), w.edges(), agent_id, entity).withColumn("warning", F.concat_ws(" ", "relation", "entity_id", "claimed_by"))
    warned = near.groupBy(F.lit(entity).alias("entity_id")).agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    return last.join(warned, "entity_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def release_entity(w: Workspace, agent_id: str, path: str, name: str, ts: int) -> DataFrame:
    entity = resolve(w, path, name)
    if entity is not None:
        w.append(ts, agent_id, [entity], "release")
    return state.fold_claims(w.log()).filter(F.col("entity_id") == entity).groupBy("entity_id").agg(F.max_by("outcome", F.struct("ts", "seq")).alias("outcome"))


def status(w: Workspace, path: str) -> DataFrame:
    return state.file_status(extract_entities(w, path).select("entity_id", "name", "entity_type"), w.log())


def who_is_editing(w: Workspace, path: str, name: str) -> DataFrame:
    entity = resolve(w, path, name)
    claims = state.current_claims(w.log()).filter(F.col("entity_id") == entity).select(F.col("claimed_by").alias("agent_id"), F.lit("claim").alias("how"))
    return claims.union(state.agent_status(w.log()).filter(F.array_contains("working_on", F.lit(entity))).select("agent_id", F.lit("working").alias("how")))


def potential_conflicts(w: Workspace, agent_id: str | None = None, now_ms: int | None = None, timeout_ms: int = 300_000) -> DataFrame:
    """Entities of the files that several agents work on or claim; with now_ms, after a cleanup of stale agents."""
    agents, claims = state.agent_status(w.log()), state.current_claims(w.log())
    if now_ms is not None:
        agents, claims = state.cleaned_up(w.log(), now_ms, timeout_ms)
    found = state.potential_conflicts(agents, claims, w.entities())
    return found if agent_id is None else found.filter(F.array_contains("agents", agent_id))


def agent_register(w: Workspace, agent_id: str, ts: int) -> DataFrame:
    w.append(ts, agent_id, [None], "register")
    return state.agent_status(w.log()).filter(F.col("agent_id") == agent_id)


def agent_heartbeat(w: Workspace, agent_id: str, working_on: list[str], ts: int) -> DataFrame:
    w.append(ts, agent_id, working_on or [None], "heartbeat")
    return state.agent_status(w.log()).filter(F.col("agent_id") == agent_id)


def preview_merge(spark: SparkSession, repo: str, ours: str, theirs: str) -> DataFrame:
    return files.merge_table(git.merge_inputs(spark, repo, ours, theirs), ["file_path"])


def _named(w: Workspace, path: str, name: str) -> DataFrame:
    all_entities = w.entities().select(F.col("entity_id").alias("id"), "name", "file_path")
    return graph.resolve_name(all_entities, name, path).select("id")


def get_dependencies(w: Workspace, path: str, name: str) -> DataFrame:
    return graph.dependencies(w.edges(), _named(w, path, name))


def get_dependents(w: Workspace, path: str, name: str) -> DataFrame:
    return graph.dependents(w.edges(), _named(w, path, name))


def impact_analysis(w: Workspace, path: str, name: str) -> DataFrame:
    return graph.impact(w.edges(), _named(w, path, name))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity_id, change, was between two (path, content) tables."""
    table = lambda x: files.entity_table(x, "path", "content")
    return entities.diff_with_renames(table(before), table(after))


def versions(spark: SparkSession, repo: str, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the files that changed between two revisions, at each of them; absent files are left out."""
    git.register(spark)
    paths = "\n".join(git.changed_paths(repo, before, after))
    read = lambda rev: spark.read.format("gitblobs").options(repo=repo, rev=rev, paths=paths).load().filter("content <> ''")
    return read(before), read(after)


def diff_refs(spark: SparkSession, repo: str, before: str, after: str) -> DataFrame:
    """entity_id, change, was between two revisions."""
    return diff(*versions(spark, repo, before, after))


def diff_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files_analyzed (those that differ) and total_changes."""
    changes = diff(before, after).agg(F.count(F.lit(1)).alias("total_changes"))
    return git.diff_versions(before, after).agg(F.count(F.lit(1)).alias("files_analyzed")).crossJoin(changes)


def impact_totals(w: Workspace, path: str, name: str) -> DataFrame:
    """One row: total_affected."""
    return impact_analysis(w, path, name).agg(F.count(F.lit(1)).alias("total_affected"))


def summary_totals(w: Workspace, path: str) -> DataFrame:
    """One row: conflict_count."""
    return merge_summary(w, path).agg(F.count(F.lit(1)).alias("conflict_count"))


def sync(known: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """The entity state after the files were read (claims and versions stay), and one row with the number of entities read."""
    read = w.entities()
    return state.upsert(known, read), read.agg(F.count(F.lit(1)).alias("synced"))


def record_merge(known: DataFrame, merged: DataFrame) -> DataFrame:
    """The entity state after merged files (file_path, content) were written."""
    return state.upsert(known, files.entity_table(merged.filter("content is not null"), "file_path", "content"))


def merge_summary(w: Workspace, path: str) -> DataFrame:
    """The conflicts that markers in a file describe."""
    return w.files.filter(F.col("path") == path).lateralJoin(ParseConflicts(F.col("content").outer())).drop("content")


def validate_merge(w: Workspace, before: DataFrame) -> DataFrame:
    """Edges between entities that changed since `before`, both of whose ends changed."""
    old, new = files.entity_table(before, "path", "content"), w.entities()
    changed = entities.modified_by_name(old, new, ["file_path", "name"], "content_hash")
    ids = new.join(changed, ["file_path", "name"]).select(F.col("entity_id").alias("id"))
    return graph.validate(w.edges(), ids)
