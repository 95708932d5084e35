"""Path expressions: slashes, parts, globs, extension and directory predicates."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: str) -> Column:
    """A listed file's path below ``root``, a plain path or a URI; listings give local files as ``file:/``."""
    base = re.sub(r"^file:/+", "/", root.rstrip("/")) + "/"
    return F.element_at(F.split(path, F.lit("\\Q" + base + "\\E"), 2), -1)


def status_path(root: str, path: str) -> str:
    """How a status names a path: relative to the workspace, with slashes, '' for none."""
    path = path.strip()
    base = os.path.abspath(root)
    return os.path.relpath(os.path.join(base, path), base).replace(os.sep, "/") if path else ""


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows; '' without a dot."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a path glob: ``*`` and ``?`` within a segment, ``**`` across, ``[..]`` and ``{a,b}``."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
            continue
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        c = glob[at]
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            body = glob[at + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\") + "]")
            at = end + 1
            continue
        if c in "*?":
            out.append("[^/]*" if c == "*" else "[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def literal_prefix(glob: str) -> str:
    """What every match starts with: reaches the parquet scan as a StartsWith filter."""
    return re.match(r"[^*?\[{\\]*", glob)[0] if "/" in glob else ""


def matches_glob(path: Column, glob: str | None) -> Column:
    """A blank glob matches all; one without a slash is tried on the base name too."""
    wanted = (glob or "").strip().replace("\\", "/")
    if not wanted:
        return F.lit(True)
    found = slashes(path).rlike(glob_regex(wanted))
    if "/" not in wanted:
        return found | basename(path).rlike(glob_regex(wanted))
    prefix = literal_prefix(wanted)
    return (path.startswith(prefix) | F.contains(path, F.lit("\\"))) & found if prefix else found


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case does not matter, entries may leave out the dot, and an empty list passes everything."""
    if not extensions:
        return F.lit(True)
    wanted = sorted({e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions})
    return F.lower(extension(path)).isin(wanted)


def in_skipped_dir(path: Column, skipped: list[str]) -> Column:
    """Any component of the path is one of the names."""
    if not skipped:
        return F.lit(False)
    return F.arrays_overlap(F.split(slashes(path), "/"), F.array(*[F.lit(s) for s in skipped]))


def is_watched(path: Column, extensions: list[str], skipped: list[str]) -> Column:
    return ~in_skipped_dir(path, skipped) & (has_extension(path, extensions) | (extension(path) == ""))


def chunk_type(path: Column) -> Column:
    ext = F.lower(extension(path))
    return F.when(ext.isin(".md", ".markdown", ".mdc", ".txt"), "markdown").when(ext.isin(".yaml", ".yml", ".json", ".toml"), "config").otherwise("code")


#: How names of folders that clients keep in step with a cloud begin.
CLOUD_MARKERS = ("gdrive", "googledrive", "yandexdisk", "onedrive", "dropbox", "icloud")


def in_cloud_folder(path: Column) -> Column:
    """A component that, in lower case and without blanks, dots, underscores and hyphens, begins like a synced folder."""
    parts = F.split(F.regexp_replace(F.lower(slashes(path)), r"[ ._\-\t]", ""), "/")
    return F.exists(parts, lambda p: p.rlike("^(" + "|".join(CLOUD_MARKERS) + ")"))
