"""Coordination state as folds over an append-only operation log.

A log row is (ts, seq, agent_id, entity_id, op, payload); seq orders rows of one
time. ops: register, heartbeat, claim, release, modify.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM_COLUMNS = "entity_id string, ts long, seq long, agent_id string, op string, outcome string, claimed_by string"


def outcome_of(owner: str | None, op: str, agent_id: str | None) -> tuple[str, str | None]:
    """What a claim or release does to an entity that `owner` holds, and who holds it then."""
    if op == "claim":
        if owner is None:
            return "claimed", agent_id
        return ("already_owned_by_self" if owner == agent_id else "already_claimed"), owner
    return ("released", None) if owner is not None and owner == agent_id else ("ignored", owner)


def fold_claims(log: DataFrame) -> DataFrame:
    """The outcome of each claim and release, in log order per entity.

    claimed; already_owned_by_self; already_claimed; released; ignored (a release by
    another agent changes nothing). Rows stream past in order and only the owner is
    carried, so an entity with a third of the log takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owner, begun = None, None, False
        for rows in batches:
            outcomes, owners = [], []
            for entity, op, agent in zip(*(rows[c].to_pylist() for c in ("entity_id", "op", "agent_id")), strict=True):
                if not begun or entity != now:
                    now, owner, begun = entity, None, True
                outcome, owner = outcome_of(owner, op, agent)
                outcomes.append(outcome)
                owners.append(owner)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(outcomes, pa.string()), pa.array(owners, pa.string())], [*rows.schema.names, "outcome", "claimed_by"])

    taken = log.filter(F.col("op").isin("claim", "release")).select("entity_id", "ts", "seq", "agent_id", "op")
    return taken.repartition("entity_id").sortWithinPartitions("entity_id", "ts", "seq", "agent_id", "op").mapInArrow(run, CLAIM_COLUMNS)


def current_claims(log: DataFrame) -> DataFrame:
    """entity_id, claimed_by after the whole log; unclaimed entities give no row."""
    folded = fold_claims(log)
    return folded.groupBy("entity_id").agg(F.max_by("claimed_by", F.struct("ts", "seq")).alias("claimed_by")).filter("claimed_by is not null")


def entity_status(log: DataFrame) -> DataFrame:
    """entity_id, version, last_modified_by, last_modified_at, content_hash from modify rows."""
    order = F.struct("ts", "seq")
    made = log.filter("op = 'modify'").groupBy("entity_id")
    return made.agg(F.count(F.lit(1)).alias("version"), F.max_by("agent_id", order).alias("last_modified_by"), F.max("ts").alias("last_modified_at"), F.max_by("payload", order).alias("content_hash"))


def agent_status(log: DataFrame) -> DataFrame:
    """agent_id, last_seen, working_on (a sorted list) for registered agents.

    The last registration or later heartbeat counts: registering empties working_on, a
    heartbeat replaces it by the entities of all its rows (those of one ts and seq);
    heartbeats of unknown agents count for nothing.
    """
    first = log.filter("op = 'register'").groupBy("agent_id").agg(F.min(F.struct("ts", "seq")).alias("since"))
    seen = log.filter("op in ('register', 'heartbeat')").join(first, "agent_id").withColumn("at", F.struct("ts", "seq")).filter("at >= since")
    last = seen.groupBy("agent_id").agg(F.max("at").alias("at"))
    work = F.array_sort(F.collect_set(F.when(F.col("op") == "heartbeat", F.col("entity_id"))))
    return seen.join(last, ["agent_id", "at"]).groupBy("agent_id").agg(F.max("ts").alias("last_seen"), work.alias("working_on"))


def stale_agents(agents: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Agents not seen for more than timeout_ms (strictly); a clock that went back makes none stale."""
    return agents.filter((F.lit(now_ms) - F.col("last_seen")) > timeout_ms).select("agent_id", "last_seen")


def release_stale(claims: DataFrame, stale: DataFrame) -> DataFrame:
    return claims.join(stale.select(F.col("agent_id").alias("claimed_by")), "claimed_by", "left_anti")


def cleaned_up(log: DataFrame, now_ms: int, timeout_ms: int) -> tuple[DataFrame, DataFrame]:
    """The state after a cleanup: agents with status active or stale, and the claims that stale ones no longer hold."""
    agents = agent_status(log)
    stale = stale_agents(agents, now_ms, timeout_ms)
    marked = agents.withColumn("status", F.when((F.lit(now_ms) - F.col("last_seen")) > timeout_ms, "stale").otherwise("active"))
    return marked, release_stale(current_claims(log), stale)


def potential_conflicts(agents: DataFrame, claims: DataFrame, known: DataFrame) -> DataFrame:
    """entity_id, agents (sorted), n_agents for known entities that more than one agent works on or claims.

    `agents` has agent_id and working_on, and status where a cleanup has marked it: what stale agents work on doesn't count.
    """
    active = agents.filter("status <> 'stale'") if "status" in agents.columns else agents
    working = active.select(F.explode("working_on").alias("entity_id"), "agent_id")
    both = working.union(claims.select("entity_id", F.col("claimed_by").alias("agent_id"))).join(known.select("entity_id").distinct(), "entity_id", "left_semi").distinct()
    one = both.groupBy("entity_id").agg(F.array_sort(F.collect_set("agent_id")).alias("agents"), F.count(F.lit(1)).alias("n_agents"))
    return one.filter("n_agents > 1")


def upsert(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update name, type, file and hash of known entities, keep claim and version; new ones begin at version 0."""
    fields = ["name", "entity_type", "file_path", "content_hash"]
    new = incoming.select("entity_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    merged = state.join(new, "entity_id", "full_outer")
    return merged.select("entity_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in fields], "claimed_by", F.coalesce("version", F.lit(0)).alias("version"))


def claim_warnings(claims: DataFrame, edges: DataFrame, agent_id: str, entity_id: str) -> DataFrame:
    """Neighbours of an entity in the graph, in either direction, that other agents hold."""
    near = edges.filter(F.col("src") == entity_id).select(F.col("dst").alias("entity_id"), F.lit("dependency").alias("relation"))
    near = near.union(edges.filter(F.col("dst") == entity_id).select("src", F.lit("dependent")))
    return near.join(claims, "entity_id").filter(F.col("claimed_by") != agent_id)


def file_status(entities: DataFrame, log: DataFrame) -> DataFrame:
    """entities with claimed_by, version and last modification; entities without either keep nulls."""
    return entities.join(current_claims(log), "entity_id", "left").join(entity_status(log), "entity_id", "left")
