"""Entities and regions of source files, by small hand-written scanners.

An entity is a run of whole lines: its identifier is `file::type::name`, with the
parent's name for members, and an ordinal from the second entity of the same
identifier on. The regions of a file are its outermost entities and the gaps
between them; their contents, joined, are the file.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from dataclasses import dataclass

#: File endings and the scanner for each.
LANGUAGES = {
    "python": [".py", ".pyi"],
    "brace": [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs", ".go", ".java", ".c", ".h", ".cpp", ".cc", ".hpp", ".cs", ".kt", ".swift", ".php", ".scala", ".dart"],
    "json": [".json"],
    "markdown": [".md", ".markdown"],
    "keys": [".yaml", ".yml"],
    "toml": [".toml"],
    "ruby": [".rb"],
}
_HASH = r"#[^\n]*"
_COMMENTS = {"python": _HASH, "keys": _HASH, "toml": _HASH, "ruby": _HASH, "brace": r"//[^\n]*|/\*.*?\*/"}
_BY_ENDING = {e: lang for lang, endings in LANGUAGES.items() for e in endings}
_BRACE_HEAD = re.compile(
    r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|static|async|abstract|final|declare|unsafe|extern|inline|virtual|override|const(?=\s+fn))\s+)*"
    r"(?P<kind>function\*?|class|interface|enum|struct|union|impl|trait|mod|module|namespace|type|fn|func|const|let|var|object)\b\s*(?:<[^>]*>\s*)?(?P<rest>.*)$"
)
_CALL_HEAD = re.compile(r"^\s*(?:[\w:<>,*&\[\]~?@.]+\s+)*[*&]*(?P<name>[\w:~$#]+)\s*(?:<[^>]*>)?\s*\([^;]*$|^\s*(?:[\w:<>,*&\[\]~?@.]+\s+)*[*&]*(?P<short>[\w:~$#]+)\s*\([^;]*\)[^;]*\{.*$")
_NOT_NAMES = {"if", "for", "while", "switch", "return", "catch", "else", "do", "match", "loop", "new", "throw", "await", "with"}
_KINDS = {"function*": "function", "fn": "function", "func": "function", "mod": "module", "const": "variable", "let": "variable", "var": "variable"}
_CONTAINERS = {"class", "interface", "impl", "trait", "module", "namespace", "object"}


@dataclass
class Entity:
    entity_id: str
    name: str
    entity_type: str
    start_line: int
    end_line: int
    content: str
    parent_id: str | None = None

    @property
    def content_hash(self) -> str:
        return hashlib.md5(self.content.encode()).hexdigest()

    @property
    def structural_hash(self) -> str:
        """A hash of the words and signs, without the language's comments, white space and the entity's own name."""
        bare = re.sub(_COMMENTS.get(language(self.entity_id.split("::")[0]), "(?!)"), " ", self.content, flags=re.S)
        bare = re.sub(rf"(?<![A-Za-z0-9_]){re.escape(self.name)}(?![A-Za-z0-9_])", "\x00", bare)
        return hashlib.md5(" ".join(re.findall(r"\w+|[^\w\s]|\x00", bare)).encode()).hexdigest()

    @property
    def body_hash(self) -> str:
        return hashlib.md5(re.sub(rf"(?<![A-Za-z0-9_]){re.escape(self.name)}(?![A-Za-z0-9_])", "__ENTITY__", self.content).encode()).hexdigest()


def language(path: str) -> str | None:
    dot = path.rfind(".")
    return _BY_ENDING.get(path[dot:].lower()) if dot >= 0 else None


def masked(text: str) -> str:
    """text with the insides of strings and comments blanked, line by line; an apostrophe between letters opens nothing."""
    out, i, n = [], 0, len(text)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//" or two == "/*":
            end = text.find("\n", i) if two == "//" else text.find("*/", i + 2)
            end = n if end < 0 else end + (0 if two == "//" else 2)
            out.append("".join("\n" if x == "\n" else " " for x in text[i:end]))
            i = end
        elif c in "\"`" or (c == "'" and re.match(r"'(?:\\.|[^'\\\n])*'", text[i : i + 200])):
            j = i + 1
            while j < n and text[j] != c and not (c != "`" and text[j] == "\n"):
                j += 2 if text[j] == "\\" else 1
            out.append(c + "".join("\n" if x == "\n" else " " for x in text[i + 1 : j]) + (c if j < n and text[j] == c else ""))
            i = j + 1 if j < n and text[j] == c else j
        else:
            out.append(c)
            i += 1
    return "".join(out)


def parses(text: str, path: str) -> bool:
    """Whether a file is well formed as far as its language is known here: Python's grammar, JSON's, or brackets that pair."""
    lang = language(path)
    try:
        if lang == "python":
            ast.parse(text)
        elif lang == "json":
            json.loads(text)
        elif lang == "brace":
            open_at: list[str] = []
            for c in masked(text):
                if c in "([{":
                    open_at.append(c)
                elif c in ")]}" and (not open_at or open_at.pop() + c not in ("()", "[]", "{}")):
                    return False
            return not open_at
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return False
    return True


def _python(lines: list[str]) -> list[tuple]:
    found, stack, decorators = [], [], None
    for n, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        depth = len(line) - len(line.lstrip())
        if bare.startswith("@") and decorators is None:
            decorators = n
        m = re.match(r"(?:async\s+)?(def|class)\s+(\w+)", bare)
        if m and depth <= 4:
            start = n if decorators is None else decorators
            end = n
            for k in range(n + 1, len(lines)):
                inner = lines[k]
                if inner.strip() and len(inner) - len(inner.lstrip()) <= depth and not inner.strip().startswith((")", "]")):
                    break
                end = k if inner.strip() else end
            while stack and stack[-1][1] < n:
                stack.pop()
            parent = stack[-1][0] if stack else None
            if parent is None or parent[0] == "class":
                kind = "class" if m[1] == "class" else "method" if parent else "function"
                found.append((start, end, kind, m[2], parent[1] if parent else None))
                stack.append(((kind, m[2]), end))
        if not bare.startswith("@"):
            decorators = None
    return found


def _ruby(lines: list[str]) -> list[tuple]:
    """def, class and module up to the `end` of their indentation."""
    found, open_at = [], []
    for n, line in enumerate(lines):
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"(def|class|module)\s+(?:self\.)?([\w:]+[?!=]?)", line.strip()):
            parent = open_at[-1][3] if open_at else None
            kind = ("method" if parent else "function") if m[1] == "def" else m[1]
            open_at.append((n, depth, kind, m[2], parent))
        elif line.strip() == "end" and open_at and open_at[-1][1] == depth:
            start, _, kind, name, parent = open_at.pop()
            found.append((start, n, kind, name, parent))
    return found


def _brace(text: str, lines: list[str]) -> list[tuple]:
    clean = masked(text).split("\n")
    found = []

    def block_end(n: int, last: int) -> int:
        depth, opened = 0, False
        for k in range(n, last):
            for c in clean[k]:
                if c in "{([":
                    depth, opened = depth + 1, opened or c == "{"
                elif c in "})]":
                    depth -= 1
            if depth <= 0 and (opened or clean[k].rstrip().endswith((";", ","))):
                return k
            if depth <= 0 and not opened and k > n + 2:
                return n
        return last - 1

    def scan(first: int, last: int, parent: str | None) -> None:
        n = first
        while n < last:
            line = clean[n]
            head = _BRACE_HEAD.match(line)
            name = kind = None
            if head and head["kind"] in ("struct", "union", "enum") and "(" in line.split("{")[0]:
                head = None  # the result type of a function
            if head:
                rest = re.match(r"[\w$]+(?:\s+for\s+[\w<>$]+)?", head["rest"].strip())
                name, kind = (rest[0] if rest else ""), _KINDS.get(head["kind"], head["kind"])
                go = re.match(r"\(\s*\w+\s+\*?(\w+)\s*\)\s*(\w+)", head["rest"].strip()) if head["kind"] == "func" else None
                if go:
                    name, kind = go[2], "method"
                if kind == "variable" and parent is not None:
                    name = None
            elif "(" in line and not line.lstrip().startswith(("#", "}", ")", "(")):
                call = _CALL_HEAD.match(line)
                if call and (call["name"] or call["short"]) and (call["name"] or call["short"]) not in _NOT_NAMES:
                    end = block_end(n, last)
                    if "{" in "".join(clean[n : end + 1]) and "=" not in line.split("(")[0]:
                        name, kind = call["name"] or call["short"], "method" if parent else "function"
            if not name:
                n += 1
                continue
            end = block_end(n, last)
            start = n
            while start > first and lines[start - 1].strip().startswith(("@", "#[")):
                start -= 1
            found.append((start, end, kind, name, parent))
            if kind in _CONTAINERS and end > n:
                scan(n + 1, end, name)
            n = end + 1

    scan(0, len(lines), None)
    return found


def _keyed(lines: list[str], head: re.Pattern, kind: str) -> list[tuple]:
    marks = [(n, m[1]) for n, line in enumerate(lines) if (m := head.match(line))]
    out = []
    for k, (n, name) in enumerate(marks):
        end = (marks[k + 1][0] if k + 1 < len(marks) else len(lines)) - 1
        while end > n and not lines[end].strip():
            end -= 1
        out.append((n, end, kind, name, None))
    return out


def _json(text: str, lines: list[str]) -> list[tuple]:
    clean, out, depth, open_at = masked(text).split("\n"), [], 0, None
    for n, line in enumerate(clean):
        if depth == 1 and (m := re.match(r'\s*"([^"]*)"\s*:', lines[n])):
            open_at = (n, m[1])
        depth += sum(c in "{[" for c in line) - sum(c in "}]" for c in line)
        if open_at and depth <= 1 and (line.rstrip().endswith(",") or depth == 1):
            out.append((open_at[0], n, "property", open_at[1], None))
            open_at = None
    return out


def extract_entities(text: str, path: str) -> list[Entity]:
    lang = language(path)
    if lang is None or not text:
        return []
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if lang == "python":
        found = _python(lines)
    elif lang == "brace":
        found = _brace(text, lines)
    elif lang == "ruby":
        found = _ruby(lines)
    elif lang == "json":
        found = _json(text, lines)
    elif lang == "markdown":
        found = _keyed(lines, re.compile(r"#{1,6}\s+(.*\S)"), "heading")
    elif lang == "toml":
        found = _keyed(lines, re.compile(r"\[+([^\]]+)\]+"), "table")
    else:
        found = _keyed(lines, re.compile(r"([\w.-]+):"), "property")
    out, seen = [], {}
    for start, end, kind, name, parent in sorted(found, key=lambda x: (x[0], -x[1])):
        plain = f"{path}::{kind}::{name}" + (f"::{parent}" if parent else "")
        seen[plain] = n = seen.get(plain, 0) + 1
        of = next((e.entity_id for e in reversed(out) if e.name == parent and e.start_line <= start + 1 and e.end_line >= end + 1), None) if parent else None
        out.append(Entity(plain if n == 1 else f"{plain}#{n}", name, kind, start + 1, end + 1, "\n".join(lines[start : end + 1]), of))
    return out


def outermost(entities: list[Entity]) -> list[Entity]:
    """Entities that no other strictly contains, by line; of equal ranges all stay."""
    out, reach = [], 0
    for e in sorted(entities, key=lambda e: (e.start_line, -e.end_line)):
        if e.end_line <= reach and not (out and (out[-1].start_line, out[-1].end_line) == (e.start_line, e.end_line)):
            continue
        out.append(e)
        reach = max(reach, e.end_line)
    return out


def leading_comment(lines: list[str], start: int, floor: int) -> int:
    """First line (0-based) of the documentation comment above `start`, one blank line at most between."""
    k = start - 1
    if k > floor and not lines[k].strip():
        k -= 1
    top = start
    while k >= floor:
        bare = lines[k].strip()
        if bare.startswith(("///", "//!", "/**", "*/", "* ")) or bare == "*" or (bare.startswith("/*") and bare.endswith("*/")):
            top, k = k, k - 1
        else:
            break
    return top


@dataclass
class Region:
    kind: str  # entity or gap
    key: str
    content: str
    entity: Entity | None = None


def extract_regions(text: str, entities: list[Entity]) -> list[Region]:
    """Gaps and outermost entities in order; a gap's key is the entity before it, so that insertions don't rename it."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    out, at, last = [], 0, "start"
    for e in outermost(entities):
        if e.start_line - 1 < at:
            continue
        top = leading_comment(lines, e.start_line - 1, at)
        if top > at:
            out.append(Region("gap", f"after:{last}", "".join(lines[at:top])))
        out.append(Region("entity", e.entity_id, "".join(lines[top : e.end_line]), e))
        at, last = e.end_line, e.entity_id
    if at < len(lines) or not out:
        out.append(Region("gap", f"after:{last}", "".join(lines[at:])))
    return out


def members(container: Region, entities: list[Entity]) -> tuple[str, list[tuple[str, str]], str] | None:
    """(head, [(key, chunk)], foot) of a container: its direct members with what stands above each; None without members.

    Members that are no entities (fields, variants, signatures) are told by indentation.
    """
    own = outermost([e for e in entities if e.parent_id == container.entity.entity_id])
    if not own:
        return plain_members(container.content)
    lines = re.findall(r"[^\n]*\n|[^\n]+", container.content)
    shift = container.entity.end_line - len(lines)
    out, at, seen = [], own[0].start_line - 1 - shift, {}
    head = "".join(lines[:at])
    for k, e in enumerate(own):
        end = e.end_line - shift
        seen[e.name] = n = seen.get(e.name, 0) + 1
        out.append((f"{e.name}#{n}", "".join(lines[at:end])))
        at = end
    return head, out, "".join(lines[at:])


#: Words before a member's name.
MODIFIERS = ["export", "public", "private", "protected", "static", "abstract", "async", "override", "readonly", "pub", "fn", "def", "get", "set"]
_CALLED = re.compile(r"(\w+)\s*\(")
_FIRST = re.compile(rf"(?:(?:{'|'.join(MODIFIERS)})(?:\([^)]*\))?\s+)*(\w+)")
_BESIDE = re.compile(r"//|/\*|\*|#|@|\}|,$")


def member_name(line: str) -> str:
    """The name that stands before the first parenthesis, else the first one after modifiers, else the line's beginning."""
    bare = line.strip()
    found = _CALLED.search(re.sub(r"\bpub\([^)]*\)\s*", "", bare)) or _FIRST.match(bare)
    return found[1] if found else bare[:20]


def plain_members(text: str) -> tuple[str, list[tuple[str, str]], str] | None:
    """(head, [(key, chunk)], foot) of a container by the indentation of its first member; None without members.

    A member begins at a line of that indentation that is no comment, attribute or closing brace, holds what is
    indented deeper, and takes along the lines between it and the end of the one before.
    """
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    opener = next((k for k, x in enumerate(lines) if "{" in x or x.rstrip().endswith(":")), None)
    if opener is None:
        return None
    end = len(lines)
    if "{" in lines[opener]:
        end = next((k for k in range(len(lines) - 1, opener, -1) if lines[k].strip() in ("}", "};")), opener)
    depth = lambda x: len(x) - len(x.lstrip())
    body = range(opener + 1, end)
    first = next((depth(lines[k]) for k in body if lines[k].strip()), None)
    begins = [k for k in body if lines[k].strip() and depth(lines[k]) == first and not _BESIDE.match(lines[k].strip())]
    if not begins:
        return None
    borders = [opener + 1]
    for before, k in zip(begins, begins[1:]):
        last = max(j for j in range(before, k) if j == before or lines[j].strip() and (depth(lines[j]) > first or lines[j].strip().startswith("}")))
        borders.append(last + 1)
    out, seen = [], {}
    for k, s, e in zip(begins, borders, [*borders[1:], end]):
        name = member_name(lines[k])
        seen[name] = n = seen.get(name, 0) + 1
        out.append((f"{name}#{n}", "".join(lines[s:e])))
    return "".join(lines[: opener + 1]), out, "".join(lines[end:])
