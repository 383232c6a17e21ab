"""Change sets, contents and histories from a git work tree.

Only these readers start a process, on the driver; everything downstream is a DataFrame.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# The empty tree's name, size and count limits, folders that are not walked.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
MAX_BYTES, MAX_FILES = 800_000, 4000
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "target", "vendor", ".next", "coverage", ".turbo", "out", ".venv", "__pycache__")
HISTORY_MONTHS, HISTORY_COMMITS = 12, 1000


class GitError(RuntimeError):
    """Git failed, or a base ref could be read as an option."""


@dataclass(frozen=True)
class Mode:
    """What a change set is measured against: staged, working, base or all."""

    kind: str = "working"
    base: str | None = None

    def arguments(self) -> list[str]:
        if self.kind == "base":
            if not self.base or self.base.startswith("-"):
                raise GitError(f"not a base ref: {self.base!r}")
            return [f"{self.base}...HEAD"]
        return {"staged": ["--cached"], "working": ["HEAD"], "all": [EMPTY_TREE, "HEAD"]}[self.kind]

    def base_ref(self) -> str | None:
        return {"base": self.base, "all": None}.get(self.kind, "HEAD")


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    return done.stdout.decode(errors="replace")


def is_repository(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def diff_text(root: str, mode: Mode) -> str:
    return git(root, "diff", "--unified=3", "--no-color", "--no-ext-diff", *mode.arguments())


def changed_paths(root: str, mode: Mode) -> list[str]:
    """Paths that a change touches and that still exist; every tracked path for ``all``."""
    if mode.kind == "all":
        return git(root, "ls-files").splitlines()
    return git(root, "diff", "--name-only", "--diff-filter=d", *mode.arguments()).splitlines()


def patches(spark: SparkSession, root: str, mode: Mode) -> DataFrame:
    """(patch_id, text): the change set as one patch."""
    return spark.createDataFrame([(root, diff_text(root, mode))], "patch_id string, text string")


def _blobs(root: str, ref: str, names: list[str]) -> Iterator[tuple[str, str | None]]:
    """(path, content) of files at a commit, read one after the other from one process."""
    plain = [n for n in names if "\n" not in n]  # a request is a line
    done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="".join(f"{ref}:{n}\n" for n in plain).encode(errors="surrogateescape"), capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip())
    out, at = done.stdout, 0
    for n in plain:
        end = out.index(b"\n", at)
        told, at = out[at:end].split(b" "), end + 1
        if told[-1] in (b"missing", b"ambiguous"):
            yield n, None
            continue
        size = int(told[-1])
        yield n, out[at : at + size].decode(errors="replace") if told[-2] == b"blob" else None
        at += size + 1
    for n in (n for n in names if "\n" in n):
        one = subprocess.run(["git", "-C", root, "show", f"{ref}:{n}"], capture_output=True)
        yield n, one.stdout.decode(errors="replace") if one.returncode == 0 else None


def base_files(spark: SparkSession, root: str, mode: Mode, names: list[str]) -> DataFrame:
    """(path, content) before the change; content is null where the path was absent."""
    ref = mode.base_ref()
    rows = list(_blobs(root, ref, names)) if ref and names else [(p, None) for p in names]
    return spark.createDataFrame(rows, "path string, content string")


def head_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, modified) of the work tree; large files are left out, other than UTF-8 is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = Path(root).resolve().as_uri().replace("file:///", "file:/").rstrip("/")
    kept = files.filter(F.col("length") <= MAX_BYTES)
    return kept.select(F.substr("path", F.lit(len(base) + 2)).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").alias("modified"))


def indexed_files(spark: SparkSession, root: str, most: int = MAX_FILES) -> DataFrame:
    """Script files for the import graph: no generated paths, no hidden or skipped folders."""
    files = head_files(spark, root).filter(F.col("content").isNotNull() & ~paths.is_generated(F.col("path")))
    folder = F.split("path", "/")
    hidden = F.exists(folder, lambda s: F.startswith(s, F.lit("."))) | F.arrays_overlap(folder, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))
    scripts = files.filter(~hidden & paths.language(F.col("path")).isin("typescript", "tsx", "javascript", "jsx"))
    return scripts.orderBy("path").limit(most)


def log_text(root: str, months: int = HISTORY_MONTHS, commits: int = HISTORY_COMMITS) -> str:
    return git(root, "log", f"--since={months} months ago", f"--max-count={commits}", "--no-merges", "--no-renames", "--diff-filter=ACMR", "--name-only", "--format=%x01%s")


def parse_log(raw: DataFrame, text: str = "raw") -> DataFrame:
    """(seq, subject, files) of every commit of a log whose commits begin with U+0001."""
    blocks = raw.select(F.posexplode(F.split(F.col(text), "\u0001")).alias("seq", "block")).filter(F.trim("block") != "")
    lines = F.split("block", "\n")
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: F.trim(s)), lambda s: s != "")
    return blocks.select("seq", F.trim(F.get(lines, F.lit(0))).alias("subject"), files.alias("files"))


def first_existing(root: str, names: list[str], variable: str | None = None) -> str | None:
    """The path an environment variable names, else the first of some names below the root."""
    if variable and (own := os.environ.get(variable)):
        path = own if os.path.isabs(own) else os.path.join(root, own)
        return path if os.path.isfile(path) else None
    return next((p for p in (os.path.join(root, n) for n in names) if os.path.isfile(p)), None)
