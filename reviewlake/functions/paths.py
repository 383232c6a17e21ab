"""Predicates and normal forms of repository paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .severity import lookup

# Marks of generated paths, lock files, extensions by language, API folders.
GENERATED_MARKS = ("node_modules/", "dist/", "build/", "vendor/", "/.next/", "target/", "/__generated__/", "/generated/", ".min.")
GENERATED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "go.sum")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "go.sum", "requirements.txt")
LANGUAGES = {
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "javascript": ("js", "mjs", "cjs"),
    "jsx": ("jsx",),
    "python": ("py", "pyi"),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "csharp": ("cs",),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "c": ("c", "h"),
    "php": ("php",),
    "ruby": ("rb", "rake", "gemspec"),
    "kotlin": ("kt", "kts"),
    "swift": ("swift",),
    "scala": ("scala", "sc"),
    "bash": ("sh", "bash", "zsh"),
}
API_FOLDERS = ("routes", "route", "api", "handlers", "controllers", "endpoints", "pages", "graphql", "resolvers")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def is_generated(p: Column) -> Column:
    low = F.lower(p)
    found = basename(low).isin(*GENERATED_NAMES)
    for m in GENERATED_MARKS:
        found = found | F.contains(low, F.lit(m))
    return found


def is_lockfile(p: Column) -> Column:
    return basename(F.lower(p)).isin(*LOCK_FILES)


def language(p: Column) -> Column:
    """By what follows the last dot of the whole path, upper case counting as other."""
    return lookup(F.element_at(F.split(p, r"\."), -1), {e: lang for lang, es in LANGUAGES.items() for e in es}, "other")


def is_api_path(p: Column) -> Column:
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in API_FOLDERS]))


def normalize(p: Column) -> Column:
    """Forward slashes, no blanks about it, no leading ``./``."""
    return _without(F.trim(F.replace(p, F.lit("\\"), F.lit("/"))), "./")


def _without(p: Column, head: str) -> Column:
    """A path without ``head`` at its start: a comparison of bytes, as reports ask it of every row."""
    return F.when(F.startswith(p, F.lit(head)), F.substr(p, F.lit(len(head) + 1))).otherwise(p)


def relative(p: Column, root: str) -> Column:
    return _without(normalize(p), root.rstrip("/") + "/")


def strip_diff_prefix(p: Column) -> Column:
    return F.when(F.length(p) > 2, F.regexp_replace(p, "^[abciow]/", "")).otherwise(p)


def suffix_match(a: Column, b: Column) -> Column:
    """Whether one path is a tail of the other, at a folder's border."""
    return F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def glob_regex(glob: str) -> str:
    """An anchored pattern: ``**`` crosses folders, ``*`` and ``?`` stay in one."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def glob_match(p: Column, glob: str) -> Column:
    return F.rlike(p, F.lit(glob_regex(glob)))
