"""Small files and folders of any store that Spark can reach: journals, pointers, swaps of single files.

Everything goes through Hadoop's file system interface on the driver; none of it touches tables.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

JOURNAL, OLD, NEW = ".repair-apply.journal", ".bak", ".new"


class Folder:
    """A folder by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.has("") else []

    def read(self, name: str) -> bytes:
        with_stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream))
        finally:
            with_stream.close()

    def write(self, name: str, content: bytes, replace: bool = True) -> None:
        out = self._fs.create(self._at(name), replace)
        try:
            out.write(bytearray(content), 0, len(content))
        finally:
            out.close()

    def move(self, name: str, to: str) -> None:
        """Rename; ``to`` must not be there."""
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{name} can't become {to} in {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def replace(self, name: str, content: bytes) -> None:
        """Write a small file so that a reader sees the old or the new one; one rename where the store replaces."""
        self.write(name + NEW, content)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(self._at(name + NEW), self._at(name), options)


def swap_files(folder: Folder, files: DataFrame) -> list[str]:
    """Write ``files`` (file, digest, content) over those of the folder, all or none; names that were written.

    ``digest`` is the md5 of the bytes that were verified: a file that has changed since, is not there, or has a
    name that leaves the folder stops the whole swap.  A journal names the files first, so that ``recover`` can
    put back what an interrupted swap has moved.  Files come one at a time.
    """
    rows = files.select("file", "digest").orderBy("file").collect()
    for r in rows:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", r.file) or not folder.has(r.file) or hashlib.md5(folder.read(r.file)).hexdigest() != r.digest:
            raise OSError(f"{r.file!r} is not the file that was verified; nothing is written")
    if folder.has(JOURNAL):
        raise OSError("an earlier swap was interrupted; recover first")
    folder.write(JOURNAL, "\n".join(r.file for r in rows).encode())
    done = []
    try:
        for r in files.select("file", "content").toLocalIterator():
            folder.write(r.file + NEW, bytes(r.content))
        for r in rows:
            folder.move(r.file, r.file + OLD)
            folder.move(r.file + NEW, r.file)
            done.append(r.file)
    except Exception:
        recover(folder)
        raise
    folder.delete(JOURNAL)  # from here on the swap holds
    for name in done:
        folder.delete(name + OLD)
    return done


def recover(folder: Folder) -> list[str]:
    """Put back what an interrupted ``swap_files`` has moved, by its journal only; names that were put back."""
    if not folder.has(JOURNAL):
        return []
    back = []
    for name in folder.read(JOURNAL).decode().split("\n"):
        if name and folder.has(name + OLD):
            folder.delete(name)
            folder.move(name + OLD, name)
            back.append(name)
        folder.delete(name + NEW)
    folder.delete(JOURNAL)
    return back
