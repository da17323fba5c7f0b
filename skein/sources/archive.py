"""Content-addressed archive of snapshots: blobs, immutable manifests, and a latest pointer that is compared and swapped.

A machine's pointer is its last numbered version, a file that is linked into place once: of two writers that saw the
same version one fails to publish the next and starts again from what the other left. Blobs are gzip files. Manifests are small and handled on the driver; blobs are hashed and verified by Spark.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 12
#: Bytes of a blob that `read` returns at most.
BLOB_BYTES = 1 << 30
# The folders of an archive.
BLOBS, MANIFESTS, LATEST = "blobs", "manifests", "latest"


def canonical(manifest: dict) -> bytes:
    """A manifest's bytes: files by relative path, keys in order, indented, with a line end."""
    files = sorted(manifest["files"], key=lambda f: f["relative_path"])
    return (json.dumps(manifest | {"files": files}, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def validate(manifest: dict) -> None:
    seen = set()
    for f in manifest["files"]:
        path = f["relative_path"]
        if not path or path.startswith("/") or ".." in path.split("/") or path in seen:
            raise ValueError(f"bad or repeated path {path!r}")
        if len(f["sha256"]) != 64 or f["bytes"] < 0:
            raise ValueError(f"bad hash or size of {path!r}")
        seen.add(path)


def state_digest(manifest: dict) -> str:
    """What a snapshot holds, without when and by what it was captured."""
    return hashlib.sha256(canonical({"machine_id": manifest["machine_id"], "files": manifest["files"]})).hexdigest()


def _unpacked_hash(content: pa.Array) -> pa.Array:
    """The hash of each unpacked blob; empty for one that can't be unpacked. Blobs are unpacked in pieces."""
    out = []
    for raw in content:
        total, unpack = hashlib.sha256(), zlib.decompressobj(31)
        try:
            rest = raw.as_py()
            while rest:
                total.update(unpack.decompress(rest, 1 << 20))
                rest = unpack.unconsumed_tail
            out.append(total.hexdigest() if unpack.eof else "")
        except zlib.error:
            out.append("")
    return pa.array(out, pa.string())


class Archive:
    """An archive in a local or mounted folder."""

    def __init__(self, root: str):
        self.root = root
        for name in (BLOBS, MANIFESTS, LATEST):
            os.makedirs(f"{root}/{name}", exist_ok=True)

    def _put(self, key: str, data: bytes) -> bool:
        """Write once; False if it is there already."""
        path = f"{self.root}/{key}"
        if os.path.exists(path):
            return False
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)

    def holds(self, sha: str) -> bool:
        return os.path.exists(f"{self.root}/{self.blob_key(sha)}")

    def place(self, sha: str, part: str) -> bool:
        """Link a packed blob into place, once; False if it is there already."""
        path = f"{self.root}/{self.blob_key(sha)}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            os.link(part, path)
            return True
        except FileExistsError:
            return False

    def blob_key(self, sha: str) -> str:
        return f"{BLOBS}/{sha[:2]}/{sha}.gz"

    def _version(self, machine: str) -> int:
        """The machine's last version, 0 where it has none."""
        folder = f"{self.root}/{LATEST}/{machine}"
        return max((int(n) for n in os.listdir(folder) if n.isdigit()), default=0) if os.path.isdir(folder) else 0

    def latest(self, machine: str) -> str | None:
        version = self._version(machine)
        return open(f"{self.root}/{LATEST}/{machine}/{version:012d}").read().strip() if version else None

    def push(self, manifest: dict, blobs: dict[str, bytes]) -> str:
        """Publish a snapshot whose new blobs are at hand; `push_files` leaves them to the executors."""
        validate(manifest)
        for f in manifest["files"]:
            if not self.holds(f["sha256"]):
                data = blobs[f["sha256"]]
                if hashlib.sha256(data).hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['relative_path']}: content differs from its hash")
                self._put(self.blob_key(f["sha256"]), gzip.compress(data, mtime=0))
        return self.publish(manifest)

    def publish(self, manifest: dict) -> str:
        """Make a snapshot whose blobs are stored the machine's next version; an unchanged state is reused."""
        validate(manifest)
        machine = manifest["machine_id"]
        for _ in range(ATTEMPTS):
            version, before = self._version(machine), self.latest(machine)
            if before and state_digest(self.manifest(before)) == state_digest(manifest):
                return before
            raw = canonical(manifest)
            sha = hashlib.sha256(raw).hexdigest()
            self._put(f"{MANIFESTS}/{sha}.json", raw)
            if self._put(f"{LATEST}/{machine}/{version + 1:012d}", sha.encode()):
                return sha
        raise RuntimeError("the latest pointer kept changing")

    def push_files(self, files: DataFrame, machine: str, captured_at: str = "") -> str:
        """Publish a snapshot of files that executors read, hash, pack and store; see skein.sources.archive_sink.

        files: (relative_path, path), and any of kind, source, raw_path, copy_state, sha256. path is where all executors
        see the file; one whose sha256 is given and stored is carried on and not read.
        """
        from skein.sources import archive_sink

        return archive_sink.push(self, files, machine, captured_at)

    def read(self, sha: str, most: int = BLOB_BYTES) -> bytes:
        """A blob's content, verified; ValueError if it is damaged or longer than `most` bytes."""
        with gzip.open(f"{self.root}/{self.blob_key(sha)}") as f:
            try:
                data = f.read(most + 1)
            except (OSError, EOFError, zlib.error) as e:
                raise ValueError(f"blob {sha} is damaged") from e
        if len(data) > most:
            raise ValueError(f"blob {sha} has more than {most} bytes")
        if hashlib.sha256(data).hexdigest() != sha:
            raise ValueError(f"blob {sha} is damaged")
        return data

    def manifest(self, sha: str) -> dict:
        raw = open(f"{self.root}/{MANIFESTS}/{sha}.json", "rb").read()
        if hashlib.sha256(raw).hexdigest() != sha:
            raise ValueError(f"manifest {sha} is damaged")
        return json.loads(raw)

    def vector(self) -> dict[str, str]:
        """machine -> latest manifest, in order of machine."""
        return {m: self.latest(m) for m in sorted(os.listdir(f"{self.root}/{LATEST}"))}

    def files(self, spark: SparkSession) -> DataFrame:
        """(manifest_sha256, machine_id, relative_path, sha256, bytes) of the latest snapshots."""
        rows = spark.read.option("multiLine", "true").schema("machine_id string, files array<struct<relative_path: string, sha256: string, bytes: bigint>>").json([f"{self.root}/{MANIFESTS}/{s}.json" for s in self.vector().values()])
        name = F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{64})", 1)
        return rows.select(name.alias("manifest_sha256"), "machine_id", F.explode("files").alias("f")).select("manifest_sha256", "machine_id", "f.*")

    def manifests(self, spark: SparkSession) -> DataFrame:
        """Rows of skein.plans.snapshots.MANIFEST of the latest snapshots; what a manifest leaves out is empty."""
        field = "struct<relative_path: string, sha256: string, bytes: bigint, kind: string, source: string, raw_path: string, copy_state: string>"
        names = [f"{self.root}/{MANIFESTS}/{s}.json" for s in self.vector().values()]
        schema = f"machine_id string, captured_at string, files array<{field}>"
        rows = spark.read.option("multiLine", "true").schema(schema).json(names) if names else spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_name")))
        rows = rows.select(F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{64})", 1).alias("manifest_sha256"), "machine_id", F.coalesce("captured_at", F.lit("")).alias("captured_at"), F.posexplode("files").alias("place", "f"))
        given = lambda name, other="": F.coalesce(F.col(f"f.{name}"), F.lit(other) if isinstance(other, str) else other)
        return rows.select("manifest_sha256", "machine_id", "captured_at", "place", given("kind", "session").alias("kind"), given("source").alias("source_name"), F.col("f.sha256").alias("file_sha256"),
                           "f.relative_path", given("raw_path", F.col("f.relative_path")).alias("raw_path"), "f.bytes", given("copy_state").alias("copy_state"))

    def damaged(self, spark: SparkSession, shas: list[str]) -> DataFrame:
        """(sha256) of the named blobs whose content isn't what their name says, by the executors."""
        blobs = spark.read.format("binaryFile").load([f"{self.root}/{self.blob_key(s)}" for s in shas])
        found = blobs.select(F.regexp_extract("path", r"([^/]+)\.gz$", 1).alias("sha256"), F.arrow_udf(_unpacked_hash, "string")("content").alias("actual"))
        return found.where("actual <> sha256").select("sha256")

    def stored(self, spark: SparkSession, content: bool = False) -> DataFrame:
        """(sha256, bytes[, actual]) of stored blobs; with content they are read, unpacked and hashed by the executors."""
        blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(f"{self.root}/{BLOBS}")
        name = F.regexp_extract("path", r"([^/]+)\.gz$", 1).alias("sha256")
        return blobs.select(name, F.col("length").alias("bytes"), *([F.arrow_udf(_unpacked_hash, "string")("content").alias("actual")] if content else []))

    def verify(self, spark: SparkSession) -> DataFrame:
        """(check, sha256): blobs that are missing, damaged or not referred to."""
        have, want = self.stored(spark, content=True), self.files(spark).select("sha256").distinct()
        return (want.join(have, "sha256", "left_anti").select(F.lit("missing").alias("check"), "sha256")
                .unionByName(have.where("actual <> sha256").select(F.lit("damaged").alias("check"), "sha256"))
                .unionByName(have.join(want, "sha256", "left_anti").select(F.lit("orphan").alias("check"), "sha256")))
