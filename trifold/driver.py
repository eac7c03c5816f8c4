"""A merge driver for one file: python -m trifold.driver BASE OURS THEIRS [-o OUT] [-p PATH]

Writes the merge to OUT, else over OURS; exits 0 if clean, 1 with conflicts, 2 on errors and binary files.
"""

from __future__ import annotations

import argparse
import sys

from trifold.functions.file_merge import merge_files


def sized(text: str, size: int) -> str:
    """Conflict markers of `size` characters in place of seven."""
    out, inside = [], False
    for line in text.split("\n"):
        mark = line[:7]
        if line.startswith("<<<<<<< ours"):
            inside = True
        elif not (inside and (line == "=======" or line.startswith(">>>>>>> theirs"))):
            out.append(line)
            continue
        inside = mark != ">>>>>>>"
        out.append(mark[0] * size + line[7:])
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser()
    for name in ("base", "ours", "theirs"):
        args.add_argument(name)
    args.add_argument("-o", "--output")
    args.add_argument("-p", "--path")
    args.add_argument("-l", "--marker-size", type=int, default=7)
    got = args.parse_args(argv)
    try:
        texts = [open(x, encoding="utf-8", newline="").read() for x in (got.base, got.ours, got.theirs)]
    except (OSError, UnicodeDecodeError) as error:
        print(f"cannot read: {error}", file=sys.stderr)
        return 2
    if any("\0" in x for x in texts):
        return 2
    found = merge_files(*texts, got.path or got.ours)
    with open(got.output or got.ours, "w", encoding="utf-8", newline="") as f:
        f.write(sized(found.content, got.marker_size))
    return 1 if found.conflicts else 0


if __name__ == "__main__":
    sys.exit(main())
