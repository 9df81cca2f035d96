"""Queries by path over the node table: location steps as joins on its pre-order intervals.

A node's subtree is the interval ``node_id`` .. ``last_id``, so every axis is a join of the nodes reached so
far with the nodes of the same file: children and parents by equality, the other axes by ranges.  All paths
take their first step together, then their second, and so on: the number of joins depends on the longest
path, not on how many there are.

Paths are location paths with these parts: ``/``, ``//``, ``.``, ``..``, the axes of ``AXES``, names and ``*``,
a last step ``@name`` or ``text()``, and predicates: a position, ``last()``, and tests of ``@name``, ``name``, ``.`` or
``text()`` (presence, ``=``, ``!=``, ``contains``, ``starts-with``, ``not``), joined by ``and``.  A relative path begins at the
root element.  Texts are compared with runs of white space as one blank.  Every other expression is an error
of that path, as is one that gives a number or a string instead of nodes; it never fails the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

MOST_CHARS, MOST_SHOWN = 2000, 20
AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding")
REVERSE = ("parent", "ancestor", "ancestor-or-self", "preceding-sibling", "preceding")

_LITERAL = r"\"[^\"]*\"|'[^']*'"
_STEP = re.compile(rf"(//|/|)\s*(?:([a-z-]+)::|(@))?\s*(\.\.|\.|\*|[A-Za-z_][\w.-]*(?:\(\))?)\s*((?:\[(?:[^\[\]\"']|{_LITERAL})*\]\s*)*)")
_PREDICATE = re.compile(rf"\[((?:[^\[\]\"']|{_LITERAL})*)\]")
_VALUE = r"(?:@|attribute::)([\w.-]+)|(\.)|(text\(\))|([A-Za-z_][\w.-]*)"
_TEST = re.compile(rf"(?:{_VALUE})\s*(?:(!?=)\s*({_LITERAL}|-?\d+(?:\.\d+)?))?$")
_CALL = re.compile(rf"(contains|starts-with)\(\s*(?:{_VALUE})\s*,\s*({_LITERAL})\s*\)$")
_SCALAR = re.compile(r"\s*(?:count|string|sum|number|boolean|concat|name|local-name|normalize-space|string-length|true|false|not|contains|starts-with)\s*\(|\s*[\d\"']")


def _test(term: str) -> dict:
    """One test of a predicate; raises ``ValueError`` if it is none."""
    term = term.strip()
    if term.startswith("not(") and term.endswith(")"):
        inner = _test(term[4:-1])
        if inner["kind"] == "position":
            raise ValueError("a position can't be negated")
        return inner | {"negated": not inner["negated"]}
    if m := re.fullmatch(r"(?:position\(\)\s*=\s*)?(\d+)", term):
        return {"kind": "position", "at": int(m[1]), "negated": False}
    if m := re.fullmatch(r"(?:position\(\)\s*=\s*)?last\(\)(?:\s*-\s*(\d+))?", term):
        return {"kind": "position", "at": -1 - int(m[1] or 0), "negated": False}
    if m := _CALL.match(term):
        op, value, groups = m[1], m[6], m.groups()[1:5]
    elif m := _TEST.match(term):
        op, value, groups = m[5] or "present", m[6], m.groups()[:4]
    else:
        raise ValueError(f"no predicate that is known here: {term!r}")
    kind = ("attribute", "self", "text", "child")[next(i for i, g in enumerate(groups) if g)]
    out = {"kind": kind, "name": groups[0] or groups[3], "op": op, "negated": False}
    if value is not None:
        out |= {"value": " ".join(value[1:-1].split())} if value[0] in "\"'" else {"number": float(value)}
    return out


def _terms(body: str) -> list[str]:
    """Parts of a predicate between ``and`` outside quotes."""
    parts = [""]
    for piece in re.split(rf"({_LITERAL})", body):
        if piece[:1] in ("'", '"'):
            parts[-1] += piece
        else:
            first, *rest = re.split(r"\s+and\s+", piece)
            parts[-1] += first
            parts += rest
    return parts


def compile_path(path: str) -> tuple[str, list[dict]]:
    """What a path selects (``element``, ``attribute``, ``text``) and its steps; raises ``ValueError``."""
    if len(path) > MOST_CHARS:
        raise ValueError("the path is too long")
    if _SCALAR.match(path):
        raise ValueError("not a selector of nodes")
    steps: list[dict] = []
    kind, at, path = "element", 0, path.strip()
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or not m[0] or (at and not m[1]) or kind != "element":
            raise ValueError(f"no path that is known here, from {path[at : at + 30]!r}")
        sep, axis, attribute, name, predicates = m.groups()
        at = m.end()
        if not steps:
            steps.append({"axis": "document" if sep else "root", "name": "*", "tests": []})
        if attribute or axis == "attribute":
            kind, axis = "attribute", "self"
        elif name == "text()":
            kind, axis = "text", axis or "self"
            if axis not in ("self", "child"):
                raise ValueError("text() takes no axis here")
            axis = "self"
        elif name in (".", ".."):
            if axis or predicates:
                raise ValueError("a dot takes neither axis nor predicate")
            axis, name = ("self", "*") if name == "." else ("parent", "*")
        elif name.endswith("()") and name != "node()":
            raise ValueError(f"no node test that is known here: {name}")
        axis = axis or "child"
        if axis not in AXES:
            raise ValueError(f"no axis: {axis}")
        if kind != "element" and predicates:
            raise ValueError("no predicate on attributes and texts")
        tests = [_test(t) for p in _PREDICATE.findall(predicates) for t in _terms(p)]
        if any(t["kind"] == "position" for p in _PREDICATE.findall(predicates) if len(terms := _terms(p)) > 1 for t in map(_test, terms)):
            raise ValueError("a position stands alone in its predicate")
        if sep == "//":
            if axis == "child" and not any(t["kind"] == "position" for t in tests) and kind == "element":
                axis = "descendant"
            else:
                steps.append({"axis": "descendant-or-self", "name": "*", "tests": []})
        steps.append({"axis": axis, "name": "*" if name == "node()" or kind != "element" else name, "tests": tests} | ({"attribute": name} if kind == "attribute" else {}))
    if not steps:
        raise ValueError("the path is empty")
    return kind, steps


_TESTS = "array<struct<kind:string,name:string,op:string,value:string,number:double,at:int,negated:boolean>>"
COMPILED = f"path string, error string, kind string, attribute string, steps array<struct<axis:string,name:string,tests:{_TESTS}>>"


def compiled(paths: DataFrame) -> DataFrame:
    """(path, error, kind, attribute, steps) of each different ``path``; ``error`` says why one can't be used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    kind, steps = compile_path(p)
                    rows.append((p, None, kind, steps[-1].get("attribute"), json.dumps(steps)))
                except ValueError as e:
                    rows.append((p, str(e), None, None, None))
            yield pd.DataFrame(rows, columns=["path", "error", "kind", "attribute", "steps"])

    out = paths.where("path is not null").select("path").distinct().mapInPandas(run, "path string, error string, kind string, attribute string, steps string")
    return out.withColumn("steps", F.from_json("steps", COMPILED.split("steps ")[1]))


def _met(axis: Column) -> Column:
    """Whether node n is on ``axis`` of the context c, of the same file."""
    n, up, last, at, c_up, c_last = (F.col(x) for x in ("n.node_id", "n.up", "n.last_id", "c.at", "c.c_up", "c.c_last"))
    on = {
        "child": up == at, "self": n == at, "parent": n == c_up, "descendant": (n > at) & (n <= c_last), "descendant-or-self": (n >= at) & (n <= c_last),
        "ancestor": (n < at) & (last >= at), "ancestor-or-self": (n <= at) & (last >= at), "following-sibling": (up == c_up) & (n > at),
        "preceding-sibling": (up == c_up) & (n < at), "following": n > c_last, "preceding": last < at,
    }
    out = F.lit(False)
    for name in reversed(AXES):
        out = F.when(axis == name, on[name]).otherwise(out)
    return out


def _holds(test: Column, value: Column) -> Column:
    """A test against one value (null: there is none)."""
    text = test["value"]
    same = F.when(test["number"].isNotNull(), value.try_cast("double") == test["number"]).otherwise(value == text)
    out = F.when(test["op"] == "present", value.isNotNull()).when(test["op"] == "=", same).when(test["op"] == "!=", ~same)
    return F.coalesce(out.when(test["op"] == "contains", F.contains(value, text)).otherwise(F.startswith(value, text)), F.lit(False))


KEY = ["package", "file"]


def _kept(rows: DataFrame, nodes: DataFrame, k: int, j: int, kinds: set[str]) -> DataFrame:
    """``rows`` (of step k, with the context ``at`` of each node) that pass the j-th test of their step."""
    test = F.get(F.col("steps")[k]["tests"], F.lit(j))
    rows = rows.withColumn("t", test)
    good = F.when(F.col("t").isNull(), True)
    if "position" in kinds:
        w = Window.partitionBy(*KEY, "path", "at")
        rows = rows.withColumn("rn", F.row_number().over(w.orderBy(F.when(F.col("steps")[k]["axis"].isin(*REVERSE), -F.col("node_id")).otherwise(F.col("node_id"))))).withColumn("cnt", F.count("*").over(w))
        good = good.when(F.col("t.kind") == "position", F.col("rn") == F.when(F.col("t.at") > 0, F.col("t.at")).otherwise(F.col("cnt") + 1 + F.col("t.at")))
    value = F.when(F.col("t.kind") == "attribute", F.element_at("attrs", F.col("t.name"))).when(F.col("t.kind") == "self", F.col("text")).when(F.col("t.kind") == "text", F.nullif("own_text", F.lit("")))
    found = _holds(F.col("t"), value)
    if "child" in kinds:
        asked = rows.where("t.kind = 'child'").select(*KEY, F.col("node_id").alias("up"), "t").distinct()
        kids = nodes.select(*KEY, "up", F.col("tag").alias("kid"), F.col("text").alias("said"))
        has = asked.join(kids, [*KEY, "up"]).where((F.col("kid") == F.col("t.name")) & _holds(F.col("t"), F.col("said"))).select(*KEY, F.col("up").alias("node_id"), "t").distinct().withColumn("has", F.lit(True))
        rows = rows.join(has, [*KEY, "node_id", "t"], "left")
        found = F.when(F.col("t.kind") == "child", F.coalesce("has", F.lit(False))).otherwise(found)
    return rows.where(good.otherwise(found != F.col("t.negated"))).drop("t", "rn", "cnt", "has")


def select_nodes(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What paths select in files, and the paths that can't be used.

    ``wanted``: package, file, path.  First result: package, file, path, kind, node_id, xpath, tag, attrs, text, lead,
    value (of an attribute or text; null for an element), each node once per path.  Second: path, error.
    ``nodes`` is read once per step, so it should be a stored table.
    """
    known = graph.cut(compiled(wanted))
    shape = known.where("error is null").select(F.posexplode("steps").alias("k", "s")).select("k", "s.axis", F.posexplode_outer("s.tests").alias("j", "t")).select("k", F.when(F.col("axis") == "child", "child").otherwise("other").alias("way"), "j", "t.kind").distinct().collect()
    plan: dict[int, dict[str, dict[int, set]]] = {}
    for r in shape:  # a few rows for each place in the longest path
        tests = plan.setdefault(r.k, {}).setdefault(r.way, {})
        if r.j is not None:
            tests.setdefault(r.j, set()).add(r.kind)
    table = nodes.where("error is null").select(*KEY, "node_id", F.coalesce("parent_id", F.lit(-1)).alias("up"), "last_id", "tag", "attrs", "text", "own_text")
    asked = wanted.select(*KEY, "path").distinct().join(known.where("error is null").select("path", "steps"), "path")
    whole = table.where("up = -1").select(*KEY, F.col("last_id").alias("c_last"))
    n_steps = F.size("steps")
    # where paths begin: before the root element (-1), or at it
    begin = F.when(F.col("steps")[0]["axis"] == "document", -1).otherwise(0)
    front = asked.join(whole, KEY).withColumn("at", begin).select(*KEY, "path", "steps", "at", F.when(F.col("at") == 0, -1).otherwise(-2).alias("c_up"), "c_last")
    done = [front.select(*KEY, "path", F.col("at").alias("node_id")).limit(0)]
    for k in sorted(plan)[1:]:
        step = F.col("steps")[k]
        live, made = front.where(n_steps > k), []
        for way, tests in sorted(plan[k].items()):
            own = step["axis"] == "child" if way == "child" else step["axis"] != "child"
            same = (F.col("c.package") == F.col("n.package")) & (F.col("c.file") == F.col("n.file"))
            met = F.col("n.up") == F.col("c.at") if way == "child" else _met(F.col("c.steps")[k]["axis"])
            named = (F.col("c.steps")[k]["name"] == "*") | (F.col("c.steps")[k]["name"] == F.col("n.tag"))
            rows = live.where(own).alias("c").join(table.alias("n"), same & met & named)
            rows = rows.select("n.package", "n.file", "c.path", "c.steps", "c.at", "n.node_id", F.col("n.up").alias("c_up"), F.col("n.last_id").alias("c_last"), "n.attrs", "n.text", "n.own_text")
            for j in sorted(tests):
                rows = _kept(rows, table, k, j, tests[j])
            made.append(rows.select(*KEY, "path", "steps", F.col("node_id").alias("at"), "c_up", "c_last"))
        made.append(live.where((step["axis"] == "descendant-or-self") & (F.col("at") == -1)))  # the document itself: `//` before a step that counts places
        front = graph.cut(reduce(DataFrame.unionByName, made).dropDuplicates([*KEY, "path", "at"]))
        done.append(front.where((n_steps == k + 1) & (F.col("at") >= 0)).select(*KEY, "path", F.col("at").alias("node_id")))
    hits = reduce(DataFrame.unionByName, done)
    value = F.when(F.col("kind") == "attribute", F.element_at("attrs", F.col("attribute"))).when(F.col("kind") == "text", F.nullif("own_text", F.lit("")))
    full = hits.join(known.where("error is null").select("path", "kind", "attribute"), "path").join(nodes.where("error is null").select(*KEY, "node_id", "xpath", "tag", "attrs", "text", "own_text", "lead"), [*KEY, "node_id"])
    full = full.withColumn("value", value).where("kind = 'element' or value is not null")
    return full.select(*KEY, "path", "kind", "node_id", "xpath", "tag", "attrs", "text", "lead", "value"), known.where("error is not null").select("path", "error")


def query_xml(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers to queries of files by path, for a tool: request, error, n, matches.

    ``asked``: request, package, file, path.  ``matches`` are the first ``MOST_SHOWN`` in document order: tag, attrs and
    the text before the first child of an element (200 characters), or the value of an attribute or text.  A
    path that can't be used and a file that is not there give an error.
    """
    found, bad = select_nodes(nodes, asked)
    files = nodes.groupBy(*KEY).agg(F.max("error").alias("broken"))
    each = asked.select("request", *KEY, "path").join(found, [*KEY, "path"])
    w = Window.partitionBy("request").orderBy("node_id")
    shown = F.struct("node_id", F.when(F.col("kind") == "element", F.col("tag")).alias("tag"), F.when(F.col("kind") == "element", F.col("attrs")).alias("attrs"), F.when(F.col("kind") == "element", F.substring("lead", 1, 200)).alias("text"), F.substring("value", 1, 200).alias("value"))
    rows = each.withColumn("rn", F.row_number().over(w)).groupBy("request").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("rn") <= MOST_SHOWN, shown)).alias("matches"))
    rows = rows.withColumn("matches", F.transform(F.array_sort("matches", lambda a, b: a["node_id"] - b["node_id"]), lambda x: x.dropFields("node_id")))
    out = asked.select("request", *KEY, "path").join(bad, "path", "left").join(files, KEY, "left").join(rows, "request", "left")
    why = F.coalesce(F.col("error"), F.col("broken"), F.when(F.col("known").isNull(), F.lit("no such file")), F.when(F.col("path").isNull(), F.lit("the path is empty")))
    out = out.join(files.select(*KEY, F.lit(True).alias("known")), KEY, "left").withColumn("error", why)
    ok = F.col("error").isNull()
    return out.select("request", "error", F.when(ok, F.coalesce("n", F.lit(0))).alias("n"), F.when(ok, F.col("matches")).alias("matches"))
