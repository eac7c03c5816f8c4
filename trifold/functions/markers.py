"""Parsing of conflict markers, as a table function over texts."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

_TITLE = re.compile(r"^<{7} \S+ (?:— )?(?:(\S+) `([^`]*)`(?: \(([^,()]*), confidence: ([^()]*)\))?|\(([^()]*)\))?")


def parse(text: str) -> list[tuple]:
    """(entity_name, entity_kind, complexity, confidence, hint, ours, theirs) of each closed conflict; titles may be absent or scoped."""
    out, state, head, hint, ours, theirs = [], None, None, "", [], []
    for line in (text or "").split("\n"):
        if line.startswith("<<<<<<<"):
            state, head, hint, ours, theirs = "ours", _TITLE.match(line), "", [], []
        elif state == "ours" and line.startswith("// hint: ") and not ours and not hint:
            hint = line[len("// hint: ") :]
        elif state == "ours" and line.startswith("======="):
            state = "theirs"
        elif state == "theirs" and line.startswith(">>>>>>>"):
            kind, name, complexity, confidence, scoped = head.groups() if head else (None,) * 5
            out.append((name or scoped or "", kind or "", complexity or "?", confidence or "unknown", hint, "\n".join(ours), "\n".join(theirs)))
            state = None
        elif state:
            (ours if state == "ours" else theirs).append(line)
    return out


@udtf(returnType="entity_name string, entity_kind string, complexity string, confidence string, hint string, ours string, theirs string")
class ParseConflicts:
    def eval(self, text: str):
        yield from parse(text)
