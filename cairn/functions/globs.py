"""Four glob dialects, translated to regular expressions when the plan is made; rows only meet ``rlike``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def _classes(pattern: str, star: str, double: str | None, one: str) -> str:
    """``*``, ``?``, ``[...]`` and, where the dialect has it, ``**`` with the slashes around it."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if double is not None and pattern.startswith("**", i):
            before, after = i == 0 or pattern[i - 1] == "/", i + 2 == len(pattern) or pattern[i + 2] == "/"
            if before and after and i + 2 < len(pattern):
                out.append("(?:[^/]+/)*")  # any number of whole segments
                i += 3
                continue
            out.append(double)
            i += 2
        elif c == "*":
            out.append(star)
            i += 1
        elif c == "?":
            out.append(one)
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + r"\z"


def sqlite_glob(pattern: str) -> str:
    """``*`` crosses slashes."""
    return "(?s)" + _classes(pattern, ".*", None, ".")


def project_glob(pattern: str) -> str:
    """``*`` stays within a segment, ``**`` crosses; matches files."""
    return "(?s)" + _classes(pattern, "[^/]*", ".*", "[^/]")


def plain_glob(pattern: str) -> str:
    """``**`` is anything, ``*`` a segment; no classes."""
    out = "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", pattern))
    return f"(?s)^{out}\\z"


def path_glob(pattern: str) -> str:
    """``**`` is zero or more whole segments."""
    parts = pattern.split("/")
    out = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
        else:
            out += _classes(p, "[^/]*", None, "[^/]")[1:-2] + ("" if last else "/")
    return f"(?s)^{out}\\z"


@dataclass
class Selector:
    """Paths and languages: any of each, both where both are given."""

    paths: Sequence[str] = field(default_factory=list)
    languages: Sequence[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.paths and not self.languages:
            raise ValueError("a selector needs a path or a language")

    def column(self, path: str = "path", language: str = "programming_language") -> Column:
        on = F.lit(True)
        if self.paths:
            on = on & F.col(path).rlike("|".join(f"(?:{sqlite_glob(p)})" for p in self.paths))
        return on & F.col(language).isin(list(self.languages)) if self.languages else on


def management_scope(include: Selector | None, exclude: Selector | None) -> Column:
    """What a destructive call acts on: the include, or everything without one, less the exclude; one of both must be given."""
    if include is None and exclude is None:
        raise ValueError("name what to include or what to exclude")
    on = include.column() if include else F.lit(True)
    return on & ~exclude.column() if exclude else on


def in_scope(path: Column, includes: Sequence[str], excludes: Sequence[str]) -> Column:
    """Excludes come first; without includes everything else is in scope."""
    out = F.lit(True)
    for p in excludes:
        out = out & ~path.rlike(project_glob(p))
    return out & path.rlike("|".join(project_glob(p) for p in includes)) if includes else out
