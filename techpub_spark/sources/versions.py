"""Versions of a few tables as one: plain Parquet folders, a manifest beside them, and one pointer to the current version.

``<root>/versions/<id>/<table>`` is written whole before ``<root>/CURRENT`` names it, in one replacement of a small
file; a reader that has the pointer reads one version from end to end, whatever is published meanwhile.  A run
that ends between the two leaves a folder that nothing names, which ``prune`` deletes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folder

POINTER, MANIFEST = "CURRENT", "manifest.json"


class Versions:
    """The versions under a folder of any store that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def current(self) -> str | None:
        """Id of the current version; null before the first."""
        return self.folder.read(POINTER).decode() if self.folder.has(POINTER) else None

    def path(self, version: str, name: str = "") -> str:
        return f"{self.root}/versions/{version}" + (f"/{name}" if name else "")

    def manifest(self, version: str | None = None) -> dict:
        """``tables`` (rows, columns, digest of files) and ``facts`` of a version, the current one if none is given; empty before the first."""
        version = version or self.current()
        return json.loads(Folder(self.spark, self.path(version)).read(MANIFEST)) if version else {}

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """A table of a version; columns that it was divided by prune folders."""
        version = version or self.current()
        known = self.manifest(version).get("tables", {}) if version else {}
        if name not in known:
            raise ValueError(f"no table {name!r} in {self.root}")
        return self.spark.read.schema(known[name]["schema"]).parquet(self.path(version, name))

    def digest(self, version: str, name: str) -> str:
        """SHA-256 over the sorted names and SHA-256 of the files of a table; files are hashed where they are read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path(version, name))
        place = F.substring_index("path", f"/versions/{version}/{name}/", -1)
        lines = files.select(F.concat_ws(" ", place, F.sha2("content", 256)).alias("line")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("d"))
        return lines.first().d  # a line per file, not per row

    def publish(self, tables: dict[str, DataFrame], facts: dict, version: str, by: dict[str, list[str]] | None = None) -> str:
        """Write ``tables`` as a new version (columns in ``by`` divide a table into folders) and make it the current one.

        A version that is current already is left as it is, so that a replayed batch changes nothing.
        """
        if not version or not all(c.isalnum() or c in "._-" for c in version):
            raise ValueError(f"no version name: {version!r}")
        if self.current() == version:
            return version
        known = {}
        for name, df in tables.items():
            df.write.mode("overwrite").partitionBy(*(by or {}).get(name, [])).parquet(self.path(version, name))
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            rows = self.spark.read.schema(schema).parquet(self.path(version, name)).count()
            known[name] = {"rows": rows, "schema": schema, "digest": self.digest(version, name)}
        whole = {"version": version, "tables": known, "facts": facts}
        Folder(self.spark, self.path(version)).write(MANIFEST, json.dumps(whole, indent=1, sort_keys=True).encode())
        self.folder.replace(POINTER, version.encode())
        return version

    def verify(self, version: str | None = None) -> None:
        """An error if the files of a version differ from those that its manifest knows."""
        version = version or self.current()
        if not version:
            raise ValueError(f"nothing is published in {self.root}")
        for name, known in self.manifest(version)["tables"].items():
            if self.digest(version, name) != known["digest"]:
                raise ValueError(f"the files of {name!r} in version {version} are not those that were published")

    def prune(self, keep: int = 1) -> list[str]:
        """Delete versions but the current one and the ``keep`` last names before it; names that went."""
        now, every = self.current(), Folder(self.spark, f"{self.root}/versions").names()
        older = [v for v in every if now is None or v < now]
        gone = [v for v in every if v != now and v not in older[len(older) - keep :]] if now else []
        for v in gone:
            Folder(self.spark, f"{self.root}/versions").delete(v)
        return gone
