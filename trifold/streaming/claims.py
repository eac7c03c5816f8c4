"""Live claims: a stream of log rows, state per entity, one outcome row per claim or release."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trifold.operators.state import CLAIM_COLUMNS, outcome_of


def claim_outcomes(log: DataFrame) -> DataFrame:
    """The streaming form of operators.state.fold_claims; rows of one micro-batch are taken in log order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples(index=False):
            outcome, owner = outcome_of(owner, row.op, row.agent_id)
            out.append((key[0], row.ts, row.seq, row.agent_id, row.op, outcome, owner))
        state.update((owner,))
        yield pd.DataFrame(out, columns=["entity_id", "ts", "seq", "agent_id", "op", "outcome", "claimed_by"])

    taken = log.filter(F.col("op").isin("claim", "release")).select("entity_id", "ts", "seq", "agent_id", "op")
    return taken.groupBy("entity_id").applyInPandasWithState(run, CLAIM_COLUMNS, "owner string", "append", GroupStateTimeout.NoTimeout)


def activity(log: DataFrame, lateness: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Operations per window and op, from a stream with an event time column `at`; rows later than `lateness` are dropped."""
    return log.withWatermark("at", lateness).groupBy(F.window("at", window), "op").agg(F.count(F.lit(1)).alias("n"))
