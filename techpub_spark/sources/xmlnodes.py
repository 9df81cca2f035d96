"""XML packages: files to a node table.  One hardened parse per file; everything else is relational.

A document type declaration is refused before anything else reads the file, as are files over the cap;
a file that fails gives one error row and never fails the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024
PREFIX = r"(?i)^(DMC|PMC|DML)-.*\.xml$"

NODES = "package string, file string, digest string, node_id int, parent_id int, depth int, tag string, xpath string, line int, attrs map<string,string>, text string, own_text string, last_id int, lead string, error string"


class NotAPackageError(ValueError):
    """The folder holds no file of a package."""


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(package, file, length, content) of a package's files; only listing is read unless content is."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return raw.select(F.get(parts, F.size(parts) - 2).alias("package"), F.element_at(parts, -1).alias("file"), "length", "content").where(F.col("file").rlike(PREFIX))


def require_package(files: DataFrame) -> DataFrame:
    """``files``, or an error if there are none."""
    if files.select("file").isEmpty():
        raise NotAPackageError("no data module, publication module or list")
    return files


def icn_idents(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of the figures in a package's ``icn`` folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path.rstrip('/')}/icn").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("ident")).where(F.col("ident").startswith("ICN-")).distinct()


def shred(content: bytes) -> list[dict]:
    """Nodes of a document in document order; ``last`` is the last of a node's subtree, ``lead`` the text before
    its first child; raises ``ValueError`` where it is refused or broken."""
    parser = expat.ParserCreate()
    nodes: list[dict] = []
    stack: list[int] = []
    children: dict[int, list[int]] = {}

    def refuse(*_: object) -> None:
        raise ValueError("document type declarations are refused")

    def start(tag: str, attrs: dict) -> None:
        n = {"node_id": len(nodes), "parent_id": stack[-1] if stack else None, "depth": len(stack), "tag": tag, "line": parser.CurrentLineNumber, "attrs": attrs, "parts": [], "own": [], "lead": []}
        children.setdefault(stack[-1] if stack else -1, []).append(len(nodes))
        stack.append(len(nodes))
        nodes.append(n)

    def end(_tag: str) -> None:
        nodes[stack.pop()]["last"] = len(nodes) - 1

    def data(text: str) -> None:
        nodes[stack[-1]]["own"].append(text)
        if stack[-1] == len(nodes) - 1:
            nodes[-1]["lead"].append(text)
        for i in stack:
            nodes[i]["parts"].append(text)

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.CharacterDataHandler = start, data
    parser.EndElementHandler = end
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    for kids in children.values():
        same: dict[str, int] = {}
        for i in kids:
            same[nodes[i]["tag"]] = same.get(nodes[i]["tag"], 0) + 1
        at: dict[str, int] = {}
        for i in kids:
            tag = nodes[i]["tag"]
            at[tag] = at.get(tag, 0) + 1
            nodes[i]["step"] = f"/{tag}[{at[tag]}]" if same[tag] > 1 else f"/{tag}"
    for n in nodes:  # parents come first
        n["xpath"] = (nodes[n["parent_id"]]["xpath"] if n["parent_id"] is not None else "") + n["step"]
    return nodes


def xml_nodes(files: DataFrame) -> DataFrame:
    """Node table of ``files`` (package, file, length, content); an error row where a file is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in NODES.replace("map<string,string>", "m").split(", ")]
        for pdf in batches:
            for r in pdf.itertuples():
                base = (r.package, r.file)
                try:
                    if r.content is None:
                        raise ValueError("PARSE-002: file over the size cap")
                    digest = hashlib.md5(r.content).hexdigest()
                    rows = [(*base, digest, n["node_id"], n["parent_id"], n["depth"], n["tag"], n["xpath"], n["line"], n["attrs"], re.sub(r"\s+", " ", "".join(n["parts"])).strip(), re.sub(r"\s+", " ", "".join(n["own"])).strip(), n["last"], "".join(n["lead"]).strip(), None) for n in shred(r.content)]
                except ValueError as e:
                    said = str(e) if str(e).startswith("PARSE-") else f"PARSE-001: {e}"
                    rows = [(*base, None, None, None, None, None, None, None, None, None, None, None, None, said)]
                out = pd.DataFrame(rows, columns=cols)
                for c in ("node_id", "parent_id", "depth", "line", "last_id"):
                    out[c] = out[c].astype("Int32")
                yield out

    small = files.withColumn("content", F.when(F.col("length") <= MOST_BYTES, F.col("content")))
    return small.select("package", "file", "content").mapInPandas(run, NODES)
