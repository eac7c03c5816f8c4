"""Line merges, parsers and whole-file merges: properties and small cases."""

import random
import shutil
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trifold.functions import file_merge, merge3
from trifold.functions.file_merge import merge_files
from trifold.functions.markers import parse
from trifold.functions.parsers import extract_entities, extract_regions, member_name, outermost, parses

TEXTS = st.lists(st.sampled_from(["a", "b", "c", "", "  d"]), max_size=9).map(lambda x: "".join(y + "\n" for y in x))


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_merge_identities(b, x):
    assert merge3.merge(b, b, x).text == x and merge3.merge(b, x, b).text == x and merge3.merge(b, x, x).text == x


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_hunks_rebuild_the_side(b, x):
    base, side = merge3.split_lines(b), merge3.split_lines(x)
    out, at = [], 0
    for lo, hi, s, e in merge3.hunks(base, side):
        out += base[at:lo] + side[s:e]
        at = hi
    assert out + base[at:] == side


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(0, 8), st.integers(0, 8))
def test_conflicts_agree_with_the_usual_tool(tmp_path_factory, b, i, j):
    lines = b.split("\n")[:-1]
    ours, theirs = "\n".join(lines[:i] + ["x"] + lines[i:]) + "\n", "\n".join(lines[:j] + ["y"] + lines[j + 1 :]) + "\n"
    folder = tmp_path_factory.mktemp("m")
    for name, text in (("b", b), ("o", ours), ("t", theirs)):
        (folder / name).write_text(text)
    done = subprocess.run(["git", "merge-file", "-p", *(str(folder / n) for n in "obt")], capture_output=True, text=True)
    found = merge3.merge(b, ours, theirs)
    if done.returncode == 0 and not found.conflicts:
        assert found.text == done.stdout


PY = "import os\n\n\n@cache\ndef f(x):\n    return 1\n\n\nclass A:\n    def m(self):\n        return 1\n\n    def n(self):\n        return 2\n"
TS = "import a from 'a';\n\n/** Doc. */\nexport function f(x) {\n  return \"}\";\n}\n\nclass A {\n  m() {\n    return 1;\n  }\n}\n"


@pytest.mark.parametrize("path,text,names", [("a.py", PY, ["f", "A", "m", "n"]), ("a.ts", TS, ["f", "A", "m"]), ("a.json", '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}\n', ["a", "b"]), ("a.md", "# One\nx\n## Two\ny\n", ["One", "Two"]), ("a.yaml", "a: 1\nb:\n  c: 2\n", ["a", "b"]), ("a.rb", "module M\n  class A\n    def f(x)\n      if x\n        1\n      end\n    end\n  end\nend\n", ["M", "A", "f"]), ("a.rs", "fn f() {\n  1\n}\n\nimpl A {\n  fn g() {}\n}\n", ["f", "A", "g"])])
def test_entities_and_regions(path, text, names):
    found = extract_entities(text, path)
    assert [e.name for e in found] == names
    assert "".join(r.content for r in extract_regions(text, found)) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="def f():\n {}();'\"/*#@class", max_size=80), st.sampled_from(["a.py", "a.ts", "a.json", "a.md", "a.yaml", "a.toml"]))
def test_regions_hold_the_whole_file(text, path):
    assert "".join(r.content for r in extract_regions(text, extract_entities(text, path))) == text


def test_same_identifier_gets_an_ordinal():
    ids = [e.entity_id for e in extract_entities("int f(int a) {\n}\nint f(int b) {\n}\n", "a.c")]
    assert ids == ["a.c::function::f", "a.c::function::f#2"]


def f(name, body):
    return f"def {name}():\n    return {body}\n"


def test_independent_edits_merge():
    base = "import a\n\n" + f("f", 1) + "\n" + f("g", 2)
    ours = "import a\nimport b\n\n" + f("f", 10) + "\n" + f("g", 2)
    theirs = "import a\nimport c\n\n" + f("f", 1) + "\n" + f("h", 3) + "\n" + f("g", 2)
    found = merge_files(base, ours, theirs, "x.py")
    assert not found.conflicts and "import a\nimport b\nimport c\n" in found.content
    assert all(x in found.content for x in (f("f", 10), f("g", 2), f("h", 3)))


def test_members_merge_one_by_one():
    made = lambda a, b, more="": f"class A {{\n  f() {{\n    return {a};\n  }}\n  g() {{\n    return {b};\n  }}\n{more}}}\n"
    found = merge_files(made(1, 2), made(10, 2, "  h() {\n    return 3;\n  }\n"), made(1, 20, "  k() {\n    return 4;\n  }\n"), "x.ts")
    assert not found.conflicts and all(x in found.content for x in ("return 10;", "return 20;", "h()", "k()"))


def test_both_modified_conflicts_and_modify_delete():
    base = f("f", 1) + "\n" + f("g", 2)
    found = merge_files(base, f("f", 5) + "\n" + f("g", 2), f("f", 6) + "\n" + f("g", 2), "x.py")
    assert [c["kind"] for c in found.conflicts] == ["both_modified"]
    found = merge_files(base, f("f", 1) + "\n" + f("g", 7), f("f", 1), "x.py")
    assert found.conflicts


def test_theirs_gap_text_survives():
    base = f("f", 1) + "\n" + f("g", 2)
    theirs = f("f", 1) + "\nX = 1\n\n" + f("g", 2)
    found = merge_files(base, f("f", 3) + "\n" + f("g", 2), theirs, "x.py")
    assert not found.conflicts and "X = 1" in found.content and f("f", 3) in found.content


def test_rename_with_edit_elsewhere():
    base = "def old(a):\n    x = a\n    return x * 17\n\n" + f("g", 2)
    ours = base.replace("old", "new")
    theirs = base.replace("return 2", "return 9")
    found = merge_files(base, ours, theirs, "x.py")
    assert not found.conflicts and "def new" in found.content and "def old" not in found.content and "return 9" in found.content


def test_unsupported_and_binary():
    assert merge_files("a\n", "b\n", "c\n", "x.unknown").stats.used_fallback
    assert merge_files("a\0", "b\0", "c\0", "x.py").conflicts


def test_marker_titles():
    text = "<<<<<<< ours (m)\n1\n=======\n2\n>>>>>>> theirs (m)\n<<<<<<< HEAD\n=======\nz\n>>>>>>> other\n"
    assert [(x[0], x[5], x[6]) for x in parse(text)] == [("m", "1", "2"), ("", "", "z")]


def test_equal_ranges_both_stay():
    e = extract_entities("int f(int a) {\n}\n", "a.c")
    assert len(outermost(e + e)) == 2


def test_far_path_is_near_path():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 60))] for _ in range(2))
        assert merge3.far_path(a, b) == merge3.near_path(a, b, 200)
    a, b = ([str(rng.randrange(40)) for _ in range(700)] for _ in range(2))
    assert merge3.far_path(a, b) == merge3.near_path(a, b, 2000)


def test_long_texts_keep_their_hunks():
    base = [f"line {i}\n" for i in range(12_000)]
    ours = [f"ours {i}\n" if i % 5 == 0 else x for i, x in enumerate(base)]
    theirs = [f"theirs {i}\n" if i % 7 == 3 and i % 5 == 2 else x for i, x in enumerate(base)]
    want = [o if o != x else t for x, o, t in zip(base, ours, theirs, strict=True)]
    found = merge3.merge("".join(base), "".join(ours), "".join(theirs))
    assert found.conflicts == 0 and found.text == "".join(want)


FIELDS = "export interface Options {\n  host: string;\n  port: number;\n}\n"
VARIANTS = "#[derive(Debug)]\npub enum Shape {\n    /// A circle.\n    Circle(f64),\n    Square { side: f64 },\n}\n"


@pytest.mark.parametrize("path,base,mine,other,want", [
    ("a.ts", FIELDS, ("  port: number;\n", "  port: number;\n  path: string;\n"), ("  host: string;\n", "  host: string;\n  user?: string;\n"), ["path: string", "user?: string", "port: number"]),
    ("a.ts", FIELDS, ("  port: number;\n", "  port: number;\n  path: string;\n"), ("  port: number;\n", "  port: number;\n  user?: string;\n"), ["path: string", "user?: string", "port: number"]),
    ("a.rs", VARIANTS, ("    Square {", "    /// Three sides.\n    Triangle(f64),\n    Square {"), ("    Square {", "    Line,\n    Square {"), ["Triangle(f64)", "Line,", "Three sides"]),
    ("a.py", "class Limits:\n    low = 1\n    high = 9\n", ("    high = 9\n", "    high = 9\n    step = 2\n"), ("    high = 9\n", "    high = 9\n    unit = 'm'\n"), ["step = 2", "unit = 'm'", "high = 9"]),
])
def test_members_that_are_no_entities(path, base, mine, other, want):
    found = merge_files(base, base.replace(*mine), base.replace(*other), path)
    assert not found.conflicts and all(found.content.count(x) == 1 for x in want), found.content


@pytest.mark.parametrize("line,name", [("public int add(int a) {", "add"), ("pub(crate) fn run(&self)", "run"), ("readonly size: number;", "size"), ("Circle(f64),", "Circle"), ("async get(x) {", "get"), ("???", "???")])
def test_member_names(line, name):
    assert member_name(line) == name


def test_prototypes_are_no_structs():
    text = "struct item *find_item(struct list *l, int n);\n\nstruct item {\n\tint n;\n};\n"
    assert [(e.entity_type, e.name, e.start_line) for e in extract_entities(text, "a.h")] == [("struct", "item", 3)]


def test_conflicts_line_by_line():
    base = ["int low(struct a *x);\n", "int gone(void);\n", "int high(struct a *x);\n"]
    assert merge3.refined(base, ["int low(struct a *x, int n);\n", "int high(struct a *x);\n"], [base[0], "int gone(void);\n", "int high(struct a *x, char c);\n"]) == ["int low(struct a *x, int n);\n", "int high(struct a *x, char c);\n"]
    assert merge3.refined(["a b c\n"], ["a b d\n"], ["a b e\n"]) is None and merge3.refined([], ["x\n"], ["y\n"]) is None
    assert merge3.refined([], ["x\n", "y\n"], ["x\n"]) == ["x\n", "y\n"] and merge3.refined(["k\n"], [], ["k\n"]) == []
    three = ["".join(x) for x in (base, ["int low(struct a *x, int n);\n", *base[1:]], [base[0], "int kept(void);\n", base[2]])]
    assert merge3.merge(*three).conflicts == 1 and merge3.merge(*three, fine=True).conflicts == 0


def test_comments_are_those_of_the_language():
    one, two = (extract_entities(f"#include <a.h>\nint f(int a) {{\n#{x}\n  return a; // {y}\n}}\n", "a.c")[0] for x, y in (("if A", "x"), ("if B", "x")))
    assert one.structural_hash != two.structural_hash
    one, two = (extract_entities(f"def f(a):\n    return a  # {x}\n", "a.py")[0] for x in "xy")
    assert one.structural_hash == two.structural_hash != one.content_hash


def test_merges_that_no_longer_parse(monkeypatch):
    assert [parses(*x) for x in (("def f(:\n", "a.py"), ("x = 1\n", "a.py"), ('{"a": 1}', "a.json"), ("{", "a.json"), ("f(a[1]) { '}' }", "a.c"), ("f(a[1)] {}", "a.c"), ("(", "a.md"))] == [False, True, True, False, True, False, True]
    base = "int f() {\n  return 1;\n}\n\nint g() {\n  return 1;\n}\n"
    sides = base, base.replace("f() {\n  return 1", "f() {\n  return 2"), base.replace("g() {\n  return 1", "g() {\n  return 3")
    assert merge_files(*sides, "a.c").warnings == []
    whole = file_merge.rebuilt
    monkeypatch.setattr(file_merge, "rebuilt", lambda *a: whole(*a) + "}")
    assert merge_files(*sides, "a.c").warnings == ["parse_failed_after_merge"]
