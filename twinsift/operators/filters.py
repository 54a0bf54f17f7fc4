"""Row filters over inventories and over result groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import file_name, is_entry
from ..functions.paths import has_extension
from . import skew

# Names and extensions that are never compared.
JUNK_NAMES = [
    ".DS_Store", ".Spotlight-V100", ".Trashes", ".fseventsd", "Thumbs.db", "desktop.ini",
]
JUNK_EXTENSIONS = ["tmp", "temp", "part"]


def is_junk(path: Column) -> Column:
    """Junk by file name, by extension, or by lying below a junk directory."""
    ext = F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, JUNK_NAMES))) | ext.isin(JUNK_EXTENSIONS)


def ignore_builtin(items: DataFrame) -> DataFrame:
    return items.where(~is_junk(F.col("path")))


def _class_body(text: str) -> str:
    """Body of a character class, with everything regex-special made literal."""
    return re.sub(r"([\\\[\]^&~])", r"\\\1", text)


def glob_regex(glob: str, braces: bool = True) -> str:
    """Regular expression for a whole-text glob match.

    ``*`` and ``**`` also cross ``/``. ``braces`` enables ``{a,b}``; a
    backslash then quotes the next character.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i:i + 1] in ("!", "^")))
            if end < 0:
                out.append(r"\[")
                continue
            body, i = glob[i:end], end + 1
            negated = body[:1] == "!" or (braces and body[:1] == "^")
            out.append("[" + ("^" if negated else "") + _class_body(body[1:] if negated else body) + "]")
        elif braces and c == "{":
            depth += 1
            out.append("(?:")
        elif braces and c == "}" and depth:
            depth -= 1
            out.append(")")
        elif braces and c == "," and depth:
            out.append("|")
        elif braces and c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def _any_glob(globs: Sequence[str], name: Column, path: Column) -> Column:
    hit = F.lit(False)
    for glob in globs:
        pattern = glob_regex(glob)
        hit = hit | name.rlike(pattern) | path.rlike(pattern)
    return hit


def _ancestors(path: Column) -> Column:
    """All directories above a path: ``/a/b/c`` gives ``/a`` and ``/a/b``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    index = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        F.transform(index, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
        lambda directory: directory != "",
    )


class ExcludeRules:
    """The exclude language.

    ``file:GLOB`` files only, ``dir:GLOB`` directories with everything below,
    ``!no-ext`` files without an extension, a bare ``GLOB`` both. Globs are
    tried on the name and on the full path.
    """

    def __init__(self, rules: Sequence[str]):
        self.no_ext = "!no-ext" in rules
        self.files = [r[5:] for r in rules if r.startswith("file:")]
        self.dirs = [r[4:] for r in rules if r.startswith("dir:")]
        self.both = [r for r in rules if not r.startswith(("file:", "dir:")) and r != "!no-ext"]

    def skips_file(self, path: Column) -> Column:
        hit = _any_glob(self.files + self.both, file_name(path), path)
        return hit | ~has_extension(path) if self.no_ext else hit

    def skips_directory(self, path: Column) -> Column:
        return _any_glob(self.dirs + self.both, file_name(path), path)

    def skips(self, path: Column) -> Column:
        """A file is gone by itself or with one of its directories."""
        out = self.skips_file(path)
        if self.dirs or self.both:
            out = out | F.exists(_ancestors(path), self.skips_directory)
        return out


def exclude_rules(items: DataFrame, rules: Sequence[str]) -> DataFrame:
    return items.where(~ExcludeRules(rules).skips(F.col("path"))) if rules else items


def exclude_fnmatch(items: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Plain shell patterns on the file name or the full path."""
    hit = F.lit(False)
    for pattern in patterns:
        regex = glob_regex(pattern, braces=False)
        hit = hit | file_name(F.col("path")).rlike(regex) | F.col("path").rlike(regex)
    return items.where(~hit)


def group_text_filter(members: DataFrame, text: str, key: str = "group_id",
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Members of groups in which any path contains the text (case ignored)."""
    if not text:
        return members
    hit = F.contains(F.lower(F.col("path")), F.lit(text.lower()))
    return _groups_where(members, key, F.bool_or(hit), hot_rows)


def group_type_filter(members: DataFrame, kind: str = "all", key: str = "group_id",
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """``archive``: groups with any container entry; ``normal``: groups without."""
    if kind == "all":
        return members
    entry = (F.col("type") == "zip_entry") | is_entry(F.col("path"))
    if kind == "archive":
        return _groups_where(members, key, F.bool_or(entry), hot_rows)
    if kind == "normal":
        return _groups_where(members, key, ~F.bool_or(entry), hot_rows)
    raise ValueError(f"unknown group type: {kind!r}")


def _groups_where(members: DataFrame, key: str, test: Column, hot_rows: int) -> DataFrame:
    kept = (
        members.groupBy(key).agg(F.count("*").alias("_n"), test.alias("_ok"))
        .where("_ok").select(key, "_n")
    )
    return skew.join_to_groups(members, kept, key, "_n", "path", hot_rows).drop("_n")
