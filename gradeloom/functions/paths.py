"""Path arithmetic on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def parent_folder(path: Column, base: str | None = None) -> Column:
    """Directory of a path; ``base`` anchors relative paths."""
    if base is not None:
        path = F.when(path.startswith("/"), path).otherwise(
            F.concat(F.lit(base.rstrip("/") + "/"), path)
        )
    full = normalize_path(path)
    folder = F.regexp_extract(full, r"^(.*)/[^/]*$", 1)
    return F.when((folder == "") & full.startswith("/"), "/").otherwise(folder)


def normalize_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes without touching a file system."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def push(stack: Column, part: Column) -> Column:
        top = F.element_at(stack, -1)
        can_pop = (F.size(stack) > 0) & (F.when(F.size(stack) > 0, top) != "..")
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return (
            F.when(part != "..", F.concat(stack, F.array(part)))
            .when(F.coalesce(can_pop, F.lit(False)), popped)
            .when(rooted, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), push), "/")
    lead = F.when(F.regexp_like(path, F.lit("^//([^/]|$)")), "//").when(rooted, "/").otherwise("")
    walked = F.coalesce(F.nullif(F.concat(lead, joined), F.lit("")), F.lit("."))
    # Most paths have nothing to resolve; those skip the fold.
    messy = F.regexp_like(path, F.lit(r"^$|//|(^|/)\.{1,2}(/|$)|./$"))
    return F.when(~messy, path).otherwise(walked)


def resolve_relative_path(path: Column, json_file: Column) -> Column:
    """Blank -> null, absolute kept, relative joined to the JSON file's folder."""
    p = strip(path)
    folder = F.regexp_extract(json_file, r"^(.*)/[^/]*$", 1)
    root = F.when((folder == "") & json_file.startswith("/"), "/").otherwise(
        F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    )
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit(None).cast("string")).when(
        p.startswith("/"), p
    ).otherwise(normalize_path(F.concat(root, p)))


def clean_prefix(prefix: str) -> str:
    cleaned = prefix.strip().rstrip("/")
    if not cleaned:
        raise ValueError("an empty prefix would match every absolute path")
    return cleaned


def has_path_prefix(path: Column, old: str) -> Column:
    old = clean_prefix(old)
    return F.coalesce((path == old) | path.startswith(old + "/"), F.lit(False))


def rewrite_path_prefix(path: Column, old: str, new: str) -> Column:
    """Swap the prefix at a path boundary; other values pass unchanged."""
    tail = F.substring(path, F.lit(len(clean_prefix(old)) + 1), F.length(path))
    return F.when(has_path_prefix(path, old), F.concat(F.lit(new.strip().rstrip("/")), tail)).otherwise(path)
