"""Ignore patterns: shell globs in order, of which the last that matches decides."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, functions as F


def normal_pattern(pattern: str) -> str:
    """Forward slashes, no leading ``./`` and no trailing slash."""
    p = pattern.strip().replace("\\", "/")
    return p.removeprefix("./").rstrip("/")


def to_regex(pattern: str) -> str:
    """A regular expression that the JVM reads alike for one shell glob."""
    out = fnmatch.translate(pattern)
    return out.replace("(?s:", "(?s:", 1).replace(r"\Z", "$").replace(r"\z", "$").replace("(?>", "(?:")


def _any_segment(column: str, pattern: str) -> Column:
    return F.exists(F.split(column, "/"), lambda s: s.rlike(pattern))


def ignored(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """The paths that the patterns leave out. A pattern meets a path if it matches the whole of it, any of its segments, or a directory it lies in.

    A pattern starting with ``!`` takes a path back in, even below a directory that is left out. The patterns are few and become one expression; the last of those that match decides.
    Null paths and paths that no pattern matches are not left out.
    """
    verdict = F.lit(False)
    for raw in patterns:
        keep = raw.startswith("!")
        p = normal_pattern(raw[1:] if keep else raw)
        if not p or p.startswith("#"):
            continue
        whole = F.col(column).rlike("^" + to_regex(p)) | F.col(column).rlike("^" + to_regex(p + "/*"))
        part = _any_segment(column, "^" + to_regex(p))
        verdict = F.when(whole | part, F.lit(not keep)).otherwise(verdict)
    return paths.where(F.col(column).isNotNull() & verdict)
