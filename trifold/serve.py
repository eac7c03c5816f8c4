"""The questions of trifold.api as tools over standard input and output: one JSON-RPC message a line.

python -m trifold.serve [ROOT]; methods: initialize, tools/list, tools/call. A result is the rows of
the answer as text content; an unknown tool or a failed call is an error message, and the loop goes on.
"""

from __future__ import annotations

import inspect
import json
import sys
import time
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold import api
from trifold.cli import session, workspace
from trifold.operators import files
from trifold.sources import git


def now() -> int:
    return int(time.time() * 1000)


class Tools:
    """One method per tool: its parameters are the tool's, its docstring the description, its result one or more tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _w(self) -> api.Workspace:
        return workspace(self.spark, self.root)

    def extract_entities(self, file_path: str):
        """Entities of a file with their types and lines."""
        return api.extract_entities(self._w(), file_path).select("entity_id", "name", "entity_type", "start_line", "end_line")

    def claim_entity(self, agent_id: str, file_path: str, entity_name: str):
        """Claim an entity before editing it, with warnings about neighbours that others hold."""
        return api.claim_entity(self._w(), agent_id, file_path, entity_name, now())

    def release_entity(self, agent_id: str, file_path: str, entity_name: str):
        """Release a claimed entity."""
        return api.release_entity(self._w(), agent_id, file_path, entity_name, now())

    def status(self, file_path: str):
        """Entities of a file with their claims and modifications."""
        return api.status(self._w(), file_path)

    def who_is_editing(self, file_path: str, entity_name: str):
        """Agents that hold an entity or work on it."""
        return api.who_is_editing(self._w(), file_path, entity_name)

    def potential_conflicts(self, agent_id: str = ""):
        """Entities that several agents work on or hold."""
        return api.potential_conflicts(self._w(), agent_id or None)

    def preview_merge(self, target_branch: str, base_branch: str = "HEAD"):
        """What a merge of two branches would give, by file and in all."""
        merged = api.preview_merge(self.spark, self.root, base_branch, target_branch)
        return merged.select("file_path", "is_clean", "confidence", F.size("conflicts").alias("conflicts")), files.preview(merged)

    def get_dependencies(self, file_path: str, entity_name: str):
        """Entities that an entity refers to."""
        return api.get_dependencies(self._w(), file_path, entity_name)

    def get_dependents(self, file_path: str, entity_name: str):
        """Entities that refer to an entity."""
        return api.get_dependents(self._w(), file_path, entity_name)

    def impact_analysis(self, file_path: str, entity_name: str):
        """All entities that depend on an entity, directly or not, and their number."""
        return api.impact_analysis(self._w(), file_path, entity_name), api.impact_totals(self._w(), file_path, entity_name)

    def agent_register(self, agent_id: str):
        """Register an agent."""
        return api.agent_register(self._w(), agent_id, now())

    def agent_heartbeat(self, agent_id: str, working_on: list | None = None):
        """Keep an agent active and replace the list of what it works on."""
        return api.agent_heartbeat(self._w(), agent_id, working_on or [], now())

    def diff(self, base_ref: str, target_ref: str = "HEAD"):
        """Changes of entities between two revisions, and their number."""
        sides = api.versions(self.spark, self.root, base_ref, target_ref)
        return api.diff(*sides), api.diff_totals(*sides)

    def merge_summary(self, file_path: str):
        """The conflicts that markers in a file describe, and their number."""
        return api.merge_summary(self._w(), file_path).select("entity_name", "entity_kind", "complexity", "confidence", "hint"), api.summary_totals(self._w(), file_path)

    def validate_merge(self, base_ref: str, target_ref: str = "HEAD"):
        """References between entities both of which changed between two revisions."""
        before, after = api.versions(self.spark, self.root, base_ref, target_ref)
        return api.validate_merge(api.Workspace(self.spark, after), before)


def listed(tools: Tools) -> list[dict]:
    out = []
    for name, f in inspect.getmembers(tools, inspect.ismethod):
        if not name.startswith("_"):
            taken = inspect.signature(f).parameters
            kinds = {k: {"type": "array" if "list" in str(p.annotation) else "string"} for k, p in taken.items()}
            needed = [k for k, p in taken.items() if p.default is inspect.Parameter.empty]
            out.append({"name": name, "description": f.__doc__, "inputSchema": {"type": "object", "properties": kinds, "required": needed}})
    return out


def answer(tools: Tools, message: dict) -> dict:
    method, asked = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": asked.get("protocolVersion", ""), "capabilities": {"tools": {}}, "serverInfo": {"name": "trifold", "version": "1"}}
    if method == "tools/list":
        return {"tools": listed(tools)}
    if method == "tools/call":
        known: dict[str, Callable] = {x["name"]: getattr(tools, x["name"]) for x in listed(tools)}
        found = known[asked["name"]](**asked.get("arguments", {}))
        rows = [[r.asDict(recursive=True) for r in t.toLocalIterator()] for t in ([found] if isinstance(found, DataFrame) else found)]
        return {"content": [{"type": "text", "text": json.dumps(x, default=str)} for x in rows]}
    raise ValueError(f"no method {method}")


def loop(tools: Tools, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        told: dict = {"jsonrpc": "2.0", "id": None}
        try:
            message = json.loads(line)
            if "id" not in message:  # a notification
                continue
            told["id"] = message["id"]
            told["result"] = answer(tools, message)
        except Exception as error:  # the caller is told, the next message is read
            told["error"] = {"code": -32000, "message": f"{type(error).__name__}: {str(error)[:500]}"}
        out.write(json.dumps(told) + "\n")
        out.flush()


if __name__ == "__main__":
    loop(Tools(session(), git.discover_root(*sys.argv[1:2])), sys.stdin, sys.stdout)
