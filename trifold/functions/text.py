"""Line, import, comment and conflict functions as Catalyst expressions; nothing here runs Python per row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that begin an unindented import line.
IMPORT_PREFIXES = ["import ", "from ", "use ", "require(", "package ", "#include ", "using "]
#: What a comment line begins with.
COMMENT_PREFIXES = ["//", "/*", "*", "#", '"""', "'''"]
#: Documentation tags that look like decorators.
NOT_DECORATORS = ["@param", "@return", "@type", "@see"]
#: Entity types whose members are merged one by one.
CONTAINER_TYPES = ["class", "interface", "enum", "impl", "trait", "module", "impl_item", "trait_item"]
#: File endings for which separators are not put on lines of their own.
PLAIN_ENDINGS = [
    ".json", ".yaml", ".yml", ".toml", ".lock", ".xml", ".csv", ".tsv", ".ini", ".cfg", ".conf", ".properties", ".env",
    ".md", ".markdown", ".txt", ".rst", ".svg", ".html", ".htm",
]
#: The label of each combination of (text, syntax, functional) changes, its confidence and its hint.
COMPLEXITY = [
    ("T", "high", "Cosmetic change on both sides. Pick either version or combine formatting."),
    ("S", "medium", "Structural change (rename/retype). Check callers of this entity."),
    ("F", "medium", "Logic changed on both sides. Requires understanding intent of each change."),
    ("T+S", "medium", "Renamed and reformatted. Prefer the structural change, verify formatting."),
    ("T+F", "medium", "Logic and cosmetic changes overlap. Resolve logic first, then reformat."),
    ("S+F", "low", "Structural and logic conflict. Both design and behavior differ."),
    ("T+S+F", "low", "All three dimensions conflict. Manual review required."),
    ("?", "unknown", "Could not classify. Compare both versions manually."),
]
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_INK = f"[^{_SPACE[1:-2]}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a lambda variable holds it, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def lines(text: Column) -> Column:
    """Lines without their ends: no element after a final newline, none for an empty text, a final CR removed."""
    ended = lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    whole = lambda each: F.filter(each, lambda x, i: (x != "") | (i < F.size(each) - 1))
    return F.transform(let(F.split(text, "\n", -1), whole), ended)


def trimmed(text: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def is_blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(_INK))


def _any(words: list[str]) -> str:
    return "|".join(re.escape(x) for x in words)


#: One anchored search tells what a line begins with once it is trimmed; after a word that ends in a space, something must follow.
_COMMENT = f"^(?:{_SPACE})?(?:{_any(COMMENT_PREFIXES)})"
_DECORATOR = f"^(?:{_SPACE})?(?!{_any(NOT_DECORATORS)})@"
_IMPORT = f"^(?![ \t])(?:{_SPACE})?(?:(?:{_any([p for p in IMPORT_PREFIXES if p[-1] == ' '])})(?=[\\s\\S]*{_INK})|{_any([p for p in IMPORT_PREFIXES if p[-1] != ' '])}|const (?=[\\s\\S]*require\\())"


def is_comment_line(line: Column) -> Column:
    return F.rlike(line, F.lit(_COMMENT))


def is_decorator_line(line: Column) -> Column:
    return F.rlike(line, F.lit(_DECORATOR))


def is_import_line(line: Column) -> Column:
    return F.rlike(line, F.lit(_IMPORT))


def is_import_region(text: Column) -> Column:
    """More than half of the non-blank lines are imports."""
    held = F.filter(lines(text), lambda x: ~is_blank(x))
    return let(held, lambda each: F.size(F.filter(each, is_import_line)) * 2 > F.size(each))


def is_whitespace_only_diff(a: Column, b: Column) -> Column:
    bare = lambda x: F.transform(F.filter(lines(x), lambda y: ~is_blank(y)), trimmed)
    return (a == b) | (bare(a) == bare(b))


def is_binary(text: Column) -> Column:
    """A NUL among the first 8,192 bytes."""
    return F.locate("\0", F.decode(F.substring(F.encode(text, "utf-8"), 1, 8192), "iso-8859-1")) > 0


def is_plain_format(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(False)
    for e in PLAIN_ENDINGS:
        found = found | F.endswith(low, F.lit(e))
    return found


def is_container_type(kind: Column) -> Column:
    return kind.isin(CONTAINER_TYPES)


def replace_word(text: Column, word: Column, new: str) -> Column:
    """Replace word where its neighbours are not [A-Za-z0-9_]."""
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when(word == "", text).otherwise(F.regexp_replace(text, pattern, F.lit(new)))


def body_hash(content: Column, name: Column) -> Column:
    """A hash of the content that does not depend on the entity's own name."""
    return F.md5(replace_word(content, name, "__ENTITY__").cast("binary"))


def marker_count(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.startswith(x, F.lit("<<<<<<<"))))


def merge_imports(base: Column, ours: Column, theirs: Column) -> Column:
    """Import lines as sets on the skeleton of ours: what theirs deleted goes, what theirs added follows the last import."""
    imports = lambda x: F.filter(lines(x), is_import_line)
    sides = F.struct(imports(base).alias("b"), lines(ours).alias("o"), imports(theirs).alias("t"))
    text = let(let(sides, _kept_and_added), _joined_imports)
    return let(text, lambda x: F.concat(x, F.repeat(F.lit("\n"), F.greatest(_final_newlines(ours) - _final_newlines(x), F.lit(0)))))


def _kept_and_added(s: Column) -> Column:
    """struct(kept, flags, added): lines of ours that stay, whether each is an import, and imports that only theirs has."""
    marked = F.transform(s["o"], lambda x: F.struct(x.alias("line"), is_import_line(x).alias("is_import")))
    kept = lambda m: F.filter(m, lambda x: ~(x["is_import"] & F.array_contains(s["b"], x["line"]) & ~F.array_contains(s["t"], x["line"])))
    added = F.filter(s["t"], lambda x: ~F.array_contains(s["b"], x) & ~F.array_contains(s["o"], x))
    return F.struct(let(marked, kept).alias("kept"), added.alias("added"))


def _joined_imports(s: Column) -> Column:
    kept = s["kept"]
    last = F.coalesce(F.array_max(F.transform(kept, lambda x, i: F.when(x["is_import"], i + 1))), F.lit(0))
    line = lambda x: x["line"]
    put = lambda n: F.concat(F.transform(F.slice(kept, F.lit(1), n), line), s["added"], F.transform(F.slice(kept, n + 1, F.greatest(F.size(kept) - n, F.lit(0))), line))
    return F.array_join(let(last, put), "\n")


def _final_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.rtrim(text, F.lit("\n")))


def split_decorators(content: Column) -> Column:
    """struct(decorators, body): the leading decorator lines and the rest."""

    def parts(each: Column) -> Column:
        n = F.coalesce(F.array_min(F.transform(each, lambda x, i: F.when(~is_decorator_line(x), i))), F.size(each))
        body = lambda k: F.array_join(F.slice(each, k + 1, F.greatest(F.size(each) - k, F.lit(0))), "\n")
        return let(n, lambda k: F.struct(F.slice(each, F.lit(1), k).alias("decorators"), body(k).alias("body")))

    return let(lines(content), parts)


def merge_decorators(base: Column, ours: Column, theirs: Column) -> Column:
    """Base decorators that neither side deleted, then those new in ours, then those new in theirs."""
    kept = F.filter(base, lambda x: F.array_contains(ours, x) & F.array_contains(theirs, x))
    return F.array_union(F.array_union(kept, F.array_except(ours, base)), F.array_except(theirs, base))


def cleanup(text: Column) -> Column:
    """Consecutive equal non-blank lines become one, blank runs are cut to two; the final newline stays."""

    def keep(each: Column) -> Column:
        before = lambda i, k: F.get(each, i - k)
        third = lambda i: (i > 1) & is_blank(before(i, 1)) & is_blank(before(i, 2))
        return F.filter(each, lambda x, i: F.when(is_blank(x), ~third(i)).otherwise((i == 0) | (x != before(i, 1))))

    joined = F.array_join(let(lines(text), keep), "\n")
    return let(joined, lambda x: F.when(F.endswith(text, F.lit("\n")) & ~F.endswith(x, F.lit("\n")), F.concat(x, F.lit("\n"))).otherwise(x))


def cap_blank_runs(text: Column) -> Column:
    """At most two empty lines in a row."""
    return F.regexp_replace(text, "\n{4,}", "\n\n\n")


def change_dimensions(base: Column, other: Column) -> Column:
    """struct(text, syntax, functional): what kind of change leads from base to other."""
    code = lambda x: F.filter(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda y: ~is_comment_line(y))
    parts = lambda x: F.struct(F.coalesce(F.get(x, 0), F.lit("")).alias("first"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("rest"), code(x).alias("code"))

    def compare(s: Column) -> Column:
        b, o = s["b"], s["o"]
        head, body, same_code = b["first"] != o["first"], b["rest"] != o["rest"], b["code"] == o["code"]
        comment = is_comment_line(b["first"]) | is_comment_line(o["first"])
        differs = base != other
        text = differs & ((head & comment) | (body & same_code))
        return F.struct(text.alias("text"), (differs & head & ~comment).alias("syntax"), (differs & body & ~same_code).alias("functional"))

    return let(F.struct(let(lines(base), parts).alias("b"), let(lines(other), parts).alias("o")), compare)


def classify_conflict(base: Column, ours: Column, theirs: Column) -> Column:
    """The complexity label of a conflict; an absent version is the empty text."""
    b, o, t = (F.coalesce(x, F.lit("")) for x in (base, ours, theirs))

    def label(s: Column) -> Column:
        parts = [F.when(s["a"][k] | s["c"][k], F.lit(v)) for k, v in (("text", "T"), ("syntax", "S"), ("functional", "F"))]
        return F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("?"))

    return let(F.struct(change_dimensions(b, o).alias("a"), change_dimensions(b, t).alias("c")), label)


def _looked_up(label: Column, at: int) -> Column:
    found = F.lit(COMPLEXITY[-1][at])
    for row in COMPLEXITY[:-1]:
        found = F.when(label == row[0], F.lit(row[at])).otherwise(found)
    return found


def confidence_of(label: Column) -> Column:
    return _looked_up(label, 1)


def hint_of(label: Column) -> Column:
    return _looked_up(label, 2)


def conflict_markers(entity_type: Column, name: Column, label: Column, ours: Column, theirs: Column) -> Column:
    """Both versions between markers that name the entity, its complexity and confidence."""
    title = F.format_string("%s `%s` (%s, confidence: %s)", entity_type, name, label, confidence_of(label))
    ended = lambda x: F.when((x != "") & ~F.endswith(x, F.lit("\n")), F.concat(x, F.lit("\n"))).otherwise(x)
    o, t = (ended(F.coalesce(x, F.lit(""))) for x in (ours, theirs))
    return F.concat(F.lit("<<<<<<< ours — "), title, F.lit("\n// hint: "), hint_of(label), F.lit("\n"), o, F.lit("=======\n"), t, F.lit(">>>>>>> theirs — "), title, F.lit("\n"))


def conflict_kind_text(kind: Column, modified_in_ours: Column, base_name: Column, ours_name: Column, theirs_name: Column) -> Column:
    renamed = F.format_string("both renamed: '%s' → ours '%s', theirs '%s'", base_name, ours_name, theirs_name)
    return (
        F.when(kind == "both_modified", F.lit("both modified"))
        .when((kind == "modify_delete") & modified_in_ours, F.lit("modified in ours, deleted in theirs"))
        .when(kind == "modify_delete", F.lit("deleted in ours, modified in theirs"))
        .when(kind == "both_added", F.lit("both added"))
        .when(kind == "rename_rename", renamed)
    )


def stats_text(s: dict[str, Column]) -> Column:
    """One line for merge counters: counters of zero are left out, but for unchanged."""
    names = [("ours_only", "ours-only"), ("theirs_only", "theirs-only"), ("both_changed_merged", "auto-merged"), ("added_ours", "added-ours"), ("added_theirs", "added-theirs"), ("deleted", "deleted"), ("conflicted", "CONFLICTS"), ("semantic_warnings", "semantic-warnings")]
    parts = [F.when(s[k] > 0, F.concat(F.lit(f"{text}: "), s[k].cast("string"))) for k, text in names if k in s]
    line = F.concat_ws(", ", F.concat(F.lit("unchanged: "), s["unchanged"].cast("string")), *parts)
    return F.when(s["used_fallback"], F.concat(line, F.lit(" (line-level fallback)"))).otherwise(line) if "used_fallback" in s else line


def right_stripped(text: Column) -> Column:
    """Trailing white space of each line, and of the text, removed."""
    return F.regexp_replace(F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, f"{_SPACE}$", "")), "\n"), f"{_SPACE}$", "")


def differing_lines(left: Column, right: Column) -> Column:
    """array<struct(line, left, right)>: lines of one number that differ beyond trailing white space; an absent line is empty."""
    bare = lambda x: F.regexp_replace(x, f"{_SPACE}$", "")

    def pairs(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(s["l"]), F.size(s["r"]), F.lit(1)) - 1)
        line = lambda side, i: F.coalesce(F.get(s[side], i), F.lit(""))
        each = F.transform(numbers, lambda i: F.struct((i + 1).alias("line"), line("l", i).alias("left"), line("r", i).alias("right")))
        return F.filter(each, lambda x: bare(x["left"]) != bare(x["right"]))

    return let(F.struct(lines(left).alias("l"), lines(right).alias("r")), pairs)


def short_hash(commit: Column) -> Column:
    return F.substring(commit, 1, 8)


def path_as_directory(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("_"))


def relative_path(path: Column, root: Column) -> Column:
    """Absolute paths under root become relative to it; others stay."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
