import io
import json
import subprocess

import pytest

from trifold import api, cli, driver, serve
from trifold.functions.file_merge import collapse_separators, expand_separators, line_fallback
from trifold.operators import bench, graph
from trifold.sources import git as source

A = "def low(x):\n    return x\n\n\ndef mid(x):\n    return low(x)\n\n\ndef top(x):\n    return mid(x)\n"


@pytest.fixture
def w(spark):
    return api.Workspace(spark, spark.createDataFrame([("a.py", A), ("b.py", "def other():\n    return 1\n")], "path string, content string"))


def test_graph(w):
    low, mid, top = (f"a.py::function::{n}" for n in ("low", "mid", "top"))
    assert {tuple(r) for r in w.edges().collect()} == {(mid, low), (top, mid)}
    assert [r.dst for r in api.get_dependencies(w, "a.py", "mid").collect()] == [low]
    assert [r.src for r in api.get_dependents(w, "a.py", "mid").collect()] == [top]
    assert {(r.id, r.depth) for r in api.impact_analysis(w, "a.py", "low").collect()} == {(mid, 1), (top, 2)}
    before = w.files.replace(A, A.replace("return x", "return -x").replace("return low(x)", "return -low(x)"), "content")
    assert [(r.src, r.dst) for r in api.validate_merge(w, before).collect()] == [(mid, low)]
    assert {r.change for r in api.diff(before, w.files).collect()} == {"modified"}
    moved = w.files.replace(A, A.replace("def low(", "def least(").replace("return low(", "return least("), "content")
    assert {(r.entity_id.split("::")[-1], r.change, r.was) for r in api.diff(w.files, moved).collect()} == {("least", "renamed", low), ("mid", "modified", None)}
    totals = api.diff_totals(w.files, moved).first()
    assert (totals.files_analyzed, totals.total_changes) == (1, 2) and api.impact_totals(w, "a.py", "low").first().total_affected == 2


def test_names_in_several_files(spark):
    files = [("a.py", "def run():\n    return go()\n\n\ndef go():\n    return 1\n"), ("b.py", "def go():\n    return 2\n"), ("c.py", "def use():\n    return go() + run()\n")]
    found = api.Workspace(spark, spark.createDataFrame(files, "path string, content string"))
    of = lambda p, n: f"{p}.py::function::{n}"
    assert {tuple(r) for r in found.edges().collect()} == {(of("a", "run"), of("a", "go")), (of("c", "use"), of("a", "run"))}
    imports = spark.createDataFrame([("c.py", "b.py")], "file_path string, imported string")
    linked = {tuple(r) for r in graph.build_edges(found.entities(), imports).collect()}
    assert linked == {(of("a", "run"), of("a", "go")), (of("c", "use"), of("b", "go")), (of("c", "use"), of("a", "run"))}


def test_sync_and_recorded_merges(w, spark):
    known = spark.createDataFrame([("a.py::function::low", "low", "function", "a.py", "old", "a1", 3)], "entity_id string, name string, entity_type string, file_path string, content_hash string, claimed_by string, version int")
    after, count = api.sync(known, w)
    rows = {r.name: r for r in after.collect()}
    assert count.first().synced == len(rows) == 4 and (rows["low"].claimed_by, rows["low"].version, rows["top"].version) == ("a1", 3, 0) and rows["low"].content_hash != "old"
    merged = spark.createDataFrame([("n.py", "def new():\n    pass\n"), ("x.py", None)], "file_path string, content string")
    assert {r.name for r in api.record_merge(after, merged).collect()} == {"low", "mid", "top", "other", "new"}


def test_commands(tmp_path, capsys, spark, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    said = lambda *a: (cli.main(["--root", str(tmp_path), *a]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text(A)
    (tmp_path / "ü b.py").write_text(A)
    git("add", "-A"), git("commit", "-qm", "1"), git("branch", "other")
    for name in ("a.py", "ü b.py"):
        (tmp_path / name).write_text(A.replace("return x", "return 1"))
    git("commit", "-qam", "2"), git("checkout", "-q", "other")
    for name in ("a.py", "ü b.py"):
        (tmp_path / name).write_text(A.replace("return mid(x)", "return mid(2)").replace("return x", "return x" if name == "a.py" else "return 9"))
    git("commit", "-qam", "3"), git("checkout", "-q", "main")
    rows = said("preview", "other")
    assert [(r["file_path"], r["is_clean"]) for r in rows[:2]] == [("a.py", True), ("ü b.py", False)] and (rows[2]["files"], rows[2]["clean"]) == (2, 1)
    assert [r["outcome"] for r in said("claim", "me", "a.py", "low")] == ["claimed"] and [r["outcome"] for r in said("claim", "you", "a.py", "low")] == ["already_claimed"]
    assert {r["name"]: r["claimed_by"] for r in said("status", "--file", "a.py")} == {"low": "me", "mid": None, "top": None}
    assert [r["outcome"] for r in said("release", "me", "a.py", "low")] == ["released"]
    (tmp_path / "cases.json").write_text(json.dumps({"file_path": "a.py", "base": A, "ours": A.replace("return x", "return 1"), "theirs": A.replace("mid(x)\n", "mid(2)\n")}) + "\n")
    assert said("bench", str(tmp_path / "cases.json"))[0]["ours_clean"] == 1
    (tmp_path / "m.py").write_text("<<<<<<< ours — function `f` (T, confidence: high)\n// hint: h\na\n=======\nb\n>>>>>>> theirs\n")
    assert said("summary", str(tmp_path / "m.py"))[0]["entity"] == "f"
    git("merge", "-q", "-s", "ours", "-m", "4", "other")
    assert said("bench-repo")[0]["tested"] == 2
    changed = {(r.entity_id.split("::")[-1], r.change) for r in api.diff_refs(spark, str(tmp_path), "main~1", "other").filter("entity_id like 'a.py%'").collect()}
    assert changed == {("low", "modified"), ("top", "modified")}
    monkeypatch.setenv("TRIFOLD_REPO", str(tmp_path))
    assert source.discover_root(str(tmp_path / "a.py")) == source.discover_root("a.py") == source.discover_root() == str(tmp_path)
    cli.main(["--root", str(tmp_path), "setup"]), cli.main(["--root", str(tmp_path), "setup"])
    assert (tmp_path / ".gitattributes").read_text().count("*.py merge=trifold") == 1


def test_claims(w):
    assert api.claim_entity(w, "a1", "a.py", "none", 1).first().outcome == "not_found"
    assert api.claim_entity(w, "a1", "a.py", "low", 2).first().outcome == "claimed"
    second = api.claim_entity(w, "a2", "a.py", "low", 3).first()
    assert (second.outcome, second.claimed_by) == ("already_claimed", "a1")
    near = api.claim_entity(w, "a2", "a.py", "mid", 4).first()
    assert near.warnings == ["dependency a.py::function::low a1"]
    assert [r.agent_id for r in api.who_is_editing(w, "a.py", "low").collect()] == ["a1"]
    api.agent_register(w, "a3", 5)
    api.agent_heartbeat(w, "a3", ["a.py::function::low"], 6)
    assert [r.agents for r in api.potential_conflicts(w, "a3").collect()] == [["a1", "a3"]]
    assert api.release_entity(w, "a1", "a.py", "low", 7).first().outcome == "released"
    assert {r.name: r.claimed_by for r in api.status(w, "a.py").collect()} == {"low": None, "mid": "a2", "top": None}


def test_separators():
    text = 'f() { a; "};"; } // {;}\n'
    assert collapse_separators(expand_separators(text)) == text
    base, ours, theirs = "f() { a(1); b(1); c(1); }\n", "f() { a(2); b(1); c(1); }\n", "f() { a(1); b(1); c(3); }\n"
    assert line_fallback(base, ours, theirs, "x.ts").content == "f() { a(2); b(1); c(3); }\n"
    assert line_fallback(base, ours, theirs, "x.txt").conflicts


def test_driver(tmp_path):
    paths = [str(tmp_path / n) for n in ("b.py", "o.py", "t.py")]
    for p, text in zip(paths, (A, A.replace("return x", "return 1"), A.replace("mid(x)\n", "mid(2)\n")), strict=True):
        open(p, "w").write(text)
    assert driver.main([*paths, "-o", str(tmp_path / "out.py")]) == 0
    out = (tmp_path / "out.py").read_text()
    assert "return 1" in out and "mid(2)" in out
    open(paths[2], "w").write(A.replace("return x", "return 2"))
    assert driver.main([*paths, "-l", "9", "-o", str(tmp_path / "out.py")]) == 1
    marks = [x[:10] for x in (tmp_path / "out.py").read_text().split("\n") if x[:7] in ("<<<<<<<", "=======", ">>>>>>>")]
    assert marks == ["<<<<<<<<< ", "=========", ">>>>>>>>> "]
    assert driver.main(paths) == 1 and driver.main(["none", *paths[1:]]) == 2


def test_bench(spark):
    cases = spark.createDataFrame([(True, True, True), (True, False, True), (True, False, False), (False, False, False), (False, True, False)], "ours_clean boolean, line_clean boolean, matches_human boolean")
    r = bench.matrix(cases).first()
    assert (r.tested, r.both_clean, r.wins, r.both_conflict, r.regressions, r.matches_human) == (5, 1, 2, 1, 1, 1) and r.human_match_rate == 0.5
    assert bench.false_conflict_reduction(cases).first().reduction == pytest.approx(2 / 3)
    files = spark.createDataFrame([("a.py", "x", "y", "z"), ("a.bin", "x", "y", "z"), ("b.py", "x", "y", "y")], "file_path string, base string, ours string, theirs string")
    assert [x.file_path for x in bench.eligible(files).collect()] == ["a.py"]


def test_tools(tmp_path, spark):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text(A)
    git("add", "-A"), git("commit", "-qm", "1")
    (tmp_path / "a.py").write_text(A.replace("return x", "return 1").replace("return low(x)", "return low(2)"))
    git("commit", "-qam", "2")
    tools, calls = serve.Tools(spark, str(tmp_path)), []
    ask = lambda name, **a: calls.append({"jsonrpc": "2.0", "id": name, "method": "tools/call", "params": {"name": name, "arguments": a}})
    low = {"file_path": "a.py", "entity_name": "low"}
    ask("agent_register", agent_id="me"), ask("claim_entity", agent_id="me", **low), ask("agent_heartbeat", agent_id="me", working_on=["a.py::function::mid"])
    ask("claim_entity", agent_id="you", file_path="a.py", entity_name="mid"), ask("who_is_editing", **low), ask("potential_conflicts"), ask("status", file_path="a.py"), ask("extract_entities", file_path="a.py")
    ask("get_dependencies", file_path="a.py", entity_name="mid"), ask("get_dependents", **low), ask("impact_analysis", **low), ask("release_entity", agent_id="me", **low)
    ask("diff", base_ref="HEAD~1"), ask("validate_merge", base_ref="HEAD~1"), ask("merge_summary", file_path="a.py"), ask("no_such_tool")
    said = io.StringIO()
    head = ['{"id": 1, "method": "initialize"}', '{"method": "notifications/initialized"}', '{"id": 2, "method": "tools/list"}', "no json"]
    serve.loop(tools, [*head, *map(json.dumps, calls)], said)
    got = [json.loads(x) for x in said.getvalue().splitlines()]
    assert got[0]["result"]["serverInfo"]["name"] == "trifold" and len(got[1]["result"]["tools"]) == 15 and "error" in got[2]
    assert "error" in got[-1] and all("result" in x for x in got[3:-1]), [x for x in got[3:-1] if "result" not in x]
    rows = [[json.loads(c["text"]) for c in x["result"]["content"]] for x in got[3:-1]]
    assert [r[0][0].get("outcome") for r in (rows[1], rows[3], rows[11])] == ["claimed", "claimed", "released"]
    assert rows[5][0][0]["agents"] == ["me", "you"] and [x["agent_id"] for x in rows[4][0]] == ["me"] and len(rows[6][0]) == len(rows[7][0]) == 3
    assert rows[10][1] == [{"total_affected": 2}] and rows[12][1] == [{"files_analyzed": 1, "total_changes": 2}] and rows[14][1] == [{"conflict_count": 0}]
    assert [(x["src"].split("::")[-1], x["dst"].split("::")[-1]) for x in rows[13][0]] == [("mid", "low")]
