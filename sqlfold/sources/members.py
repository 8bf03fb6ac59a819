"""Sink of member files (S8, S10, S11): a Python data source that publishes true files of given names.

Tasks write each file below a staging folder of their own attempt and report its name, rows, bytes
and checksum. The commit moves the files of the successful attempts to their names and then
writes ``_members/manifest.json``; an abort, or a failed commit, removes the staging folder, so a job
leaves either all of its files or none of them. Files go through the file system that
the path's scheme names.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .text import guard_nonempty

FORMAT = "sqlfold_members"
#: In a folder whose name keeps it from those who list the members.
MANIFEST = "_members/manifest.json"


def _file_system(path: str):
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), posixpath.abspath(path)
    # Spark writes a local path with one slash or three
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (name, staged path, rows, bytes, SHA-256) of each file."""

    files: list[tuple[str, str, int, int, str]]


class MemberWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, root = _file_system(self.path)
        folder = f"{root}/{self.staging}/{TaskContext.get().taskAttemptId()}"
        done: list[tuple[str, str, int, int, str]] = []
        for name, rows in groupby(iterator, key=lambda r: r["file_name"]):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name of a member: {name!r}")
            fs.create_dir(folder, recursive=True)
            n, size, check, staged = 0, 0, hashlib.sha256(), f"{folder}/{len(done)}"
            with fs.open_output_stream(staged) as out:
                for r in rows:
                    raw = r["value"].encode() + b"\n"
                    out.write(raw)
                    check.update(raw)
                    n, size = n + 1, size + len(raw)
            done.append((name, staged, n, size, check.hexdigest()))
        return Written(done)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _file_system(self.path)
        try:
            files = sorted(f for m in messages if m for f in m.files)
            names = [f[0] for f in files]
            if twice := {a for a, b in zip(names, names[1:]) if a == b}:
                raise ValueError(f"rows of one member came apart: {sorted(twice)[:3]}")
            fs.create_dir(root, recursive=True)
            there = {f.base_name for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File}
            if not self.overwrite and (clash := there.intersection(names)):
                raise ValueError(f"members exist: {sorted(clash)[:3]}")
            # without its manifest, a folder that is half replaced is known as such
            if fs.get_file_info(f"{root}/{MANIFEST}").type == FileType.File:
                fs.delete_file(f"{root}/{MANIFEST}")
            for name in there.difference(names) if self.overwrite else ():
                fs.delete_file(f"{root}/{name}")
            for name, staged, *_ in files:
                fs.move(staged, f"{root}/{name}")
            listed = [{"name": f[0], "rows": f[2], "bytes": f[3], "sha256": f[4]} for f in files]
            fs.create_dir(f"{root}/{posixpath.dirname(MANIFEST)}")
            with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
                out.write(json.dumps(listed).encode())
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, root = _file_system(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class MemberFiles(DataSource):
    """``df.write.format("sqlfold_members").option("path", folder)``: columns file_name, value; the
    rows of a file come together and in order, a line each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> MemberWriter:
        return MemberWriter(self.options["path"], overwrite)


def write_members(file_plan: DataFrame, out_dir: str) -> None:
    """The files of a plan (``plans.split_validate.file_plan``) under their names, statements in order,
    a blank line where the plan has a gap; replaces what the folder held, and refuses an empty plan
    (S13). A file is written by one task, which streams its rows."""
    plan = guard_nonempty(file_plan, "file plan")
    spark = plan.sparkSession
    spark.dataSource.register(MemberFiles)
    spaced = F.when(F.col("gap") & (F.col("position") > 1), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    (
        plan.select("file_name", "position", spaced.alias("value"))
        .repartition("file_name").sortWithinPartitions("file_name", "position")
        .select("file_name", "value")
        .write.format(FORMAT).mode("overwrite").option("path", out_dir).save()
    )


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(name, rows, bytes, sha256) of the files of a committed folder."""
    schema = "name string, rows long, bytes long, sha256 string"
    text = spark.read.text(f"{out_dir.rstrip('/')}/{MANIFEST}", wholetext=True)
    return text.select(F.inline(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
