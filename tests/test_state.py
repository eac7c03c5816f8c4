import json
import subprocess
import time

from pyspark.sql import functions as F

from trifold.operators import state
from trifold.sources import git
from trifold.streaming.claims import claim_outcomes

LOG = [
    (1, 1, "a", "e1", "claim"), (2, 2, "b", "e1", "claim"), (3, 3, "a", "e1", "claim"), (4, 4, "b", "e1", "release"),
    (5, 5, "a", "e1", "release"), (6, 6, "b", "e1", "claim"), (7, 7, "b", "e2", "claim"),
]
OUT = {1: "claimed", 2: "already_claimed", 3: "already_owned_by_self", 4: "ignored", 5: "released", 6: "claimed", 7: "claimed"}
SCHEMA = "ts long, seq long, agent_id string, entity_id string, op string"


def test_fold(spark):
    log = spark.createDataFrame(LOG, SCHEMA)
    assert {r.seq: r.outcome for r in state.fold_claims(log).collect()} == OUT
    assert {(r.entity_id, r.claimed_by) for r in state.current_claims(log).collect()} == {("e1", "b"), ("e2", "b")}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, part in enumerate((LOG[:3], LOG[3:])):
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        (folder / f"{n}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    q = claim_outcomes(stream).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.seq: r.outcome for r in spark.table("outcomes").collect()} == OUT


def test_stale_and_conflicts(spark):
    agents = spark.createDataFrame([("a", 100), ("b", 900), ("c", 2000)], "agent_id string, last_seen long")
    stale = state.stale_agents(agents, 1000, 100)
    assert [r.agent_id for r in stale.collect()] == ["a"]
    claims = spark.createDataFrame([("e1", "a"), ("e2", "b")], "entity_id string, claimed_by string")
    assert [r.entity_id for r in state.release_stale(claims, stale).collect()] == ["e2"]
    working = spark.createDataFrame([("b", ["e2"], "active"), ("c", ["e1", "e2", "e9"], "active"), ("d", ["e2"], "stale"), ("f", ["e9"], "active")], "agent_id string, working_on array<string>, status string")
    known = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    found = sorted((r.entity_id, r.agents) for r in state.potential_conflicts(working, claims, known).collect())
    assert found == [("e1", ["a", "c"]), ("e2", ["b", "c"])]


def test_time_goes_before_sequence(spark):
    log = spark.createDataFrame([(10, 5, "a", "e", "claim"), (20, 1, "a", "e", "release"), (30, 2, "b", "e", "claim")], SCHEMA)
    assert [(r.entity_id, r.claimed_by) for r in state.current_claims(log).collect()] == [("e", "b")]


def test_cleanup_and_lists(spark):
    rows = [
        (1, 1, "a", None, "register"), (2, 2, "b", None, "register"), (3, 3, "a", "e1", "heartbeat"), (3, 3, "a", "e2", "heartbeat"), (4, 4, "x", "e1", "heartbeat"),
        (5, 5, "a", "e1", "claim"), (900, 6, "b", "e2", "heartbeat"), (901, 7, "b", "e3", "claim"),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    assert {(r.agent_id, tuple(r.working_on)) for r in state.agent_status(log).collect()} == {("a", ("e1", "e2")), ("b", ("e2",))}
    agents, claims = state.cleaned_up(log, 1000, 500)
    assert {(r.agent_id, r.status) for r in agents.collect()} == {("a", "stale"), ("b", "active")}
    assert [(r.entity_id, r.claimed_by) for r in claims.collect()] == [("e3", "b")]


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "-A"), run("commit", "-qm", "1"), run("branch", "other")
    (tmp_path / "a.py").write_text("x = 2\n")
    run("commit", "-qam", "2"), run("checkout", "-q", "other")
    (tmp_path / "a.py").write_text("x = 1\ny = 3\n")
    (tmp_path / "b.py").write_text("b\n")
    run("add", "-A"), run("commit", "-qm", "3")
    rows = git.merge_inputs(spark, str(tmp_path), "main", "other").collect()
    assert [(r.file_path, r.base, r.ours, r.theirs) for r in rows] == [("a.py", "x = 1\n", "x = 2\n", "x = 1\ny = 3\n")]
    tree = git.working_tree(spark, str(tmp_path), [".py"])
    assert [r.path for r in tree.collect()] == ["a.py", "b.py"]
    assert git.commits(spark, str(tmp_path)).filter(F.size("parents") == 1).count() == 1
