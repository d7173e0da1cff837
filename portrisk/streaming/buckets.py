"""Tables in buckets that streams change, without a moment in which they are broken.

    data/bucket_write=<name>/bucket_key=<b>/   files of one write, never changed afterwards
    manifest/<version>.json     which folders make up each bucket, and the schema

A change writes new folders, then a manifest under a name of its own that one rename makes
the newest.  A driver lost before the rename leaves the table as it was; folders that no kept
manifest names are removed by a later change.  Readers use the folders of one manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifests kept, so that readers of the last ones still find their folders.
KEEP = 3
#: Folders of a bucket after which the next change writes it anew as one.
MOST_FOLDERS = 8

Folders = dict[str, list[str]]


class BucketTable:
    """Rows dealt by a text column ``bucket_key``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._paths(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions of the kept manifests, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[0] not in "._")

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._paths(f"{self.path}/manifest/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folders(self, before: int | None = None) -> Folders:
        """Folders by bucket in the newest manifest, or in the newest one older than ``before``."""
        usable = [v for v in self.versions() if before is None or v < before]
        return self._manifest(usable[-1])["folders"] if usable else {}

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._manifest(self.versions()[-1])["schema"])

    def read(self, schema: T.StructType, folders: Folders, buckets: Iterable[str] | None = None) -> DataFrame:
        """Rows (with ``bucket_key``) of the given buckets, all by default; only their files are read."""
        paths = [f"{self.path}/data/bucket_write={v}/bucket_key={b}" for b in (folders if buckets is None else buckets)
                 for v in folders.get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], _with_bucket(schema))
        laid = T.StructType([*_with_bucket(schema).fields, T.StructField("bucket_write", T.StringType())])
        return self.spark.read.schema(laid).option("basePath", f"{self.path}/data").parquet(*paths).drop("bucket_write")

    def write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows (with ``bucket_key``) to a folder of their own: (its name, the buckets in it)."""
        name = uuid.uuid4().hex[:16]
        at = f"{self.path}/data/bucket_write={name}"
        rows.repartition("bucket_key").write.partitionBy("bucket_key").parquet(at)
        return name, sorted(n.removeprefix("bucket_key=") for n in self._names(f"data/bucket_write={name}")
                            if n.startswith("bucket_key="))

    def commit(self, version: int, folders: Folders, schema: T.StructType) -> None:
        """Make ``folders`` the table as of ``version``, by one rename; then remove what is left over."""
        draft = self._paths(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        final = self._paths(f"{self.path}/manifest/{version:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"folders": folders, "schema": schema.jsonValue()}).encode()))
        out.close()
        if self._fs.exists(final):  # the same epoch once more
            self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"could not commit version {version} of {self.path}")
        self._clean()

    def _clean(self) -> None:
        versions = self.versions()
        named = {v for n in versions[-KEEP:] for vs in self._manifest(n)["folders"].values() for v in vs}
        for n in versions[:-KEEP]:
            self._fs.delete(self._paths(f"{self.path}/manifest/{n:012d}.json"), False)
        for n in self._names("data"):
            if n.removeprefix("bucket_write=") not in named:
                self._fs.delete(self._paths(f"{self.path}/data/{n}"), True)

    def add(self, rows: DataFrame, version: int) -> tuple[Folders, list[str]]:
        """Append rows (with ``bucket_key``) as ``version``, and commit: (folders, touched buckets).

        A version that was added before is added again to the one before it, so a replayed
        epoch changes nothing.  A bucket of many folders is written anew as one.
        """
        schema = T.StructType([f for f in rows.schema.fields if f.name != "bucket_key"])
        folders = self.folders(before=version)
        name, touched = self.write(rows)
        full = [b for b in touched if len(folders.get(b, [])) >= MOST_FOLDERS]
        merged = self.write(self.read(schema, {b: [*folders[b], name] for b in full}))[0] if full else None
        folders |= {b: [merged] if b in full else [*folders.get(b, []), name] for b in touched}
        self.commit(version, folders, schema)
        return folders, touched


def _with_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket_key", T.StringType())])


def bucket_of(columns: Iterable[str], buckets: int):
    """Bucket of a row by the hash of some columns; nulls have a bucket like any other value."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("string")
