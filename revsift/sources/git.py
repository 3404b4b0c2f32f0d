"""A Git repository as tables: spark.read.format("git").option("path", ...).option("table", "commits" | "files" | "file_diffs")."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "commit_hash string, seq long, author string, authored_at string, message string",
    "files": "commit_hash string, file_path string, content string",
    "file_diffs": "commit_before string, commit_after string, file_path string, added int, deleted int",
}


def git(path: str, *args: str) -> str:
    """Output of a Git command in a repository; a failure raises."""
    return subprocess.run(["git", "-C", path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


class _Commits(InputPartition):
    def __init__(self, commits: list[tuple]) -> None:
        self.commits = commits


class _Objects:
    """Contents of a repository's objects through one process, asked one by one."""

    def __init__(self, path: str) -> None:
        self.run = subprocess.Popen(["git", "-C", path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def get(self, name: str) -> str | None:
        """Null for what is not there."""
        self.run.stdin.write(name.encode() + b"\n")
        self.run.stdin.flush()
        head = self.run.stdout.readline().split()
        if head[-1:] == [b"missing"] or len(head) < 3:
            return None
        body = self.run.stdout.read(int(head[-1]))
        self.run.stdout.read(1)
        return body.decode("utf-8", "replace")

    def close(self) -> None:
        self.run.stdin.close()
        self.run.wait()


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options.get("table", "commits")
        self.ref, self.count, self.suffix = options.get("ref", "HEAD"), options.get("count"), options.get("suffix", ".py")

    def partitions(self) -> list[InputPartition]:
        """History, oldest first, in runs of commits; contents are read by the tasks."""
        n = [f"-n{int(self.count)}"] if self.count else []
        hashes = git(self.path, "log", "--format=%H", *n, self.ref).split()[::-1]
        rows = [(h, i, hashes[i - 1] if i else None) for i, h in enumerate(hashes)]
        return [_Commits(rows[i : i + 64]) for i in range(0, len(rows), 64)] or [_Commits([])]

    def read(self, partition: _Commits):
        if self.table == "commits":
            shown = git(self.path, "show", "-s", "--format=%an%x00%aI%x00%B%x00%x00", *[h for h, _, _ in partition.commits]) if partition.commits else ""
            for (h, seq, _), text in zip(partition.commits, shown.split("\0\0")):
                author, at, message = text.strip("\n").split("\0", 2)
                yield h, seq, author, at, message.strip()
        elif self.table == "files":
            objects = _Objects(self.path)
            try:
                for h, _, _ in partition.commits:
                    for line in git(self.path, "ls-tree", "-r", "-z", h).split("\0"):
                        about, _, p = line.partition("\t")
                        if p.endswith(self.suffix) and p:
                            yield h, p, objects.get(about.split()[2])
            finally:
                objects.close()
        else:
            for h, _, before in partition.commits:
                if before:
                    yield from ((before, h, *x) for x in diff_stats(self.path, before, h))


def diff_stats(path: str, before: str, after: str, file: str | None = None) -> list[tuple[str, int, int]]:
    """(file, lines added, lines deleted) between two commits; binary files have 0. Of one file: 0 and 0 where it is the same."""
    found = []
    for line in git(path, "diff", "--numstat", before, after, *(["--", file] if file else [])).splitlines():
        added, deleted, p = line.split("\t", 2)
        found.append((p.replace("\\", "/"), int(added) if added != "-" else 0, int(deleted) if deleted != "-" else 0))
    return found or ([(file, 0, 0)] if file else [])


def changed_files(path: str, before: str, after: str) -> list[str]:
    return [p for p in git(path, "diff", "--name-only", before, after).splitlines() if p]


def file_at(path: str, commit: str, file: str) -> str | None:
    """A file's content at a commit, null where it is not there."""
    try:
        return git(path, "show", f"{commit}:{file}")
    except subprocess.CalledProcessError:
        return None


def current_commit(path: str) -> str:
    return git(path, "rev-parse", "HEAD").strip()


def checkout(path: str, ref: str) -> None:
    git(path, "checkout", "--quiet", ref)


def clone(url: str, path: str) -> None:
    """Clones a repository; one that is there is brought up to date, where its branch can be moved forward."""
    if not os.path.isdir(os.path.join(path, ".git")):
        subprocess.run(["git", "clone", "--quiet", url, path], check=True, capture_output=True)
        return
    git(path, "fetch", "--quiet", "--all")
    if git(path, "rev-parse", "--abbrev-ref", "HEAD").strip() != "HEAD":
        git(path, "pull", "--quiet", "--ff-only")


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
