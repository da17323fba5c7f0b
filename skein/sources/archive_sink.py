"""A sink of archives: tasks stage blobs, the commit links them into place and publishes the snapshot.

Each attempt of a task streams its files, a piece at a time, into a folder of its own below the job's: hashed as they
are, packed as they go. What a task tells the driver is names, hashes and sizes. The commit puts staged blobs in
place where there is none of that hash (renaming, not copying), then publishes the manifest; whether the job commits
or not, its folder goes, and with it whatever lost or repeated attempts have left. A blob is named by its content, so
of attempts or jobs that store the same one any may win.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from skein.sources.archive import Archive

STAGING = "staging"
PIECE = 1 << 20
#: Links that the commit makes at a time.
SIDE_BY_SIDE = 16
_TOLD = ("kind", "source", "raw_path", "copy_state")


@dataclass
class Staged(WriterCommitMessage):
    """What an attempt of a task has read: files of the manifest, and the staged path of each blob that is new."""

    files: list[dict]
    blobs: dict[str, str]


def stage(path: str, folder: str) -> tuple[str, int, str]:
    """Hash, size and staged path of a file's content; no more than a piece of it is in memory."""
    part, digest, size = f"{folder}/{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    with open(path, "rb") as source, open(part, "wb") as raw, gzip.GzipFile("", "wb", fileobj=raw, mtime=0) as packed:
        while piece := source.read(PIECE):
            digest.update(piece)
            packed.write(piece)
            size += len(piece)
    return digest.hexdigest(), size, part


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.job = options["root"], options["job"]
        self.machine, self.captured_at = options["machine"], options.get("captured_at", "")

    @property
    def folder(self) -> str:
        return f"{self.root}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        archive, folder = Archive(self.root), f"{self.folder}/{uuid.uuid4().hex}"
        os.makedirs(folder)
        files, blobs = [], {}
        for row in iterator:
            r = row.asDict()
            known = r.get("sha256")
            if known and archive.holds(known):
                sha, size = known, r["bytes"]
            else:
                sha, size, part = stage(r["path"], folder)
                if known and known != sha:
                    raise ValueError(f"{r['relative_path']}: content differs from its hash")
                if sha in blobs or archive.holds(sha):
                    os.unlink(part)
                else:
                    blobs[sha] = part
            files.append({"relative_path": r["relative_path"], "sha256": sha, "bytes": size} | {k: r[k] for k in _TOLD if r.get(k) is not None})
        return Staged(files, blobs)

    def commit(self, messages: list[Staged | None]) -> None:
        archive, told = Archive(self.root), [m for m in messages if m is not None]
        manifest = {"machine_id": self.machine, "captured_at": self.captured_at, "files": [f for m in told for f in m.files]}
        staged = {sha: part for m in told for sha, part in m.blobs.items()}
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            list(pool.map(lambda one: archive.place(*one), staged.items()))
        sha = archive.publish(manifest)
        shutil.rmtree(self.folder, ignore_errors=True)
        os.makedirs(self.folder)
        with open(f"{self.folder}/published", "w") as f:
            f.write(sha)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class ArchiveSink(DataSource):
    """Format `skein_archive`: rows (relative_path, path, ...) become a snapshot of a machine."""

    @classmethod
    def name(cls) -> str:
        return "skein_archive"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def push(archive: Archive, files: DataFrame, machine: str, captured_at: str = "") -> str:
    """Write files (relative_path, path, ...) as the machine's next snapshot, and return its manifest's hash.

    Paths that are absolute, lead outside or occur twice are refused before anything is read; null ones too. A
    snapshot without files is one. Each partition of files is read by one task. With sha256, bytes is needed where the
    file is not to be read. The folder is one that all executors see; a driver that is lost leaves its job's folder
    below staging, which nothing refers to.
    """
    spark, job = files.sparkSession, uuid.uuid4().hex
    path = F.col("relative_path")
    bad = files.groupBy(path).agg(F.count("*").alias("n")).where(path.isNull() | (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | (F.col("n") > 1))
    if found := bad.limit(1).collect():
        raise ValueError(f"bad or repeated path {found[0].relative_path!r}")
    spark.dataSource.register(ArchiveSink)
    writer = files.write.format("skein_archive").mode("append").options(root=archive.root, job=job, machine=machine, captured_at=captured_at)
    note = f"{archive.root}/{STAGING}/{job}"
    try:
        writer.save()
        with open(f"{note}/published") as f:
            return f.read()
    finally:
        shutil.rmtree(note, ignore_errors=True)
