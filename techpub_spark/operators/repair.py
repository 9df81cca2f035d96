"""Repair: edits of XML files by path, and the verification of whole sets of candidates in one job.

An edit finds its one element by a path over the node table (``paths``) and changes that element's own bytes;
comments, prefixes, white space and the encoding of the rest stay as they are.  Edits of a file follow one
another: the k-th edits of all files are one round, so the number of jobs is that of the longest list of edits.

Candidates are verified by a copy-on-write overlay: only their edited files are parsed and checked anew, what
they share with the package is joined to them, and findings before and after are compared as multisets.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.xmlnodes import xml_nodes
from . import graph, paths, validation
from .evaluation import finding_key

EDITS = "seq int, op string, xpath string, attr string, value string, xml string, position string"
KEY = ["package", "file"]
#: Rules whose repairs may be applied after approval.
APPLICABLE = ("BREX-001", "BREX-002", "BREX-003", "BREX-004", "BREX-005", "XREF-001", "XREF-002", "XREF-003", "XREF-005", "XREF-008")


def _places(raw: bytes, namespaces: bool = False) -> list[list[int]]:
    """[begin, end of the start tag, begin of the end tag, end] of each element of UTF-8 bytes, in document order."""
    parser = expat.ParserCreate("utf-8", " ") if namespaces else expat.ParserCreate("utf-8")
    out: list[list[int]] = []
    stack: list[int] = []

    def refuse(*_: object) -> None:
        raise ValueError("document type declarations are refused")

    def start(*_: object) -> None:
        begin = parser.CurrentByteIndex
        stop = re.compile(rb"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>").match(raw, begin).end()
        stack.append(len(out))
        out.append([begin, stop, stop, stop])

    def end(_tag: str) -> None:
        at, place = parser.CurrentByteIndex, out[stack.pop()]
        if raw[place[1] - 2 : place[1]] != b"/>":
            place[2:] = [at, raw.index(b">", at) + 1]

    parser.StartDoctypeDeclHandler, parser.StartElementHandler, parser.EndElementHandler = refuse, start, end
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return out


def _text_end(raw: bytes, at: int) -> int:
    """Where the text that begins at ``at`` ends: the next tag, comment or instruction; CDATA is text."""
    while (at := raw.index(b"<", at)) >= 0 and raw.startswith(b"<![CDATA[", at):
        at = raw.index(b"]]>", at) + 3
    return at


def _escaped(text: str, quote: str = "") -> bytes:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    if quote:
        out = out.replace(quote, "&quot;" if quote == '"' else "&apos;").replace("\n", "&#10;").replace("\t", "&#9;")
    return out.encode()


def _spliced(raw: bytes, node: int, e: dict) -> bytes:
    """UTF-8 bytes after one edit of the element with number ``node``."""
    op, value = e["op"], e.get("value")
    if (op in ("set_attr", "set_text") and value is None) or (op == "set_attr" and not e.get("attr")) or (op == "insert_element" and not e.get("xml")):
        raise ValueError(f"{op} lacks a field")
    begin, inner, close, end = _places(raw)[node]
    empty = raw[inner - 2 : inner] == b"/>"
    if op == "set_attr":
        tag, name = raw[begin:inner], e["attr"].encode()
        for m in re.finditer(rb"\s+([^\s=/>]+)\s*=\s*(\"[^\"]*\"|'[^']*')", tag):
            if m[1] == name:
                quote = m[2][:1]
                return raw[: begin + m.start(2)] + quote + _escaped(value, quote.decode()) + quote + raw[begin + m.end(2) :]
        at = begin + len(tag[: -2 if empty else -1].rstrip())
        return raw[:at] + b" " + name + b'="' + _escaped(value, '"') + b'"' + raw[at:]
    if op == "set_text":
        if empty:
            tag = raw[begin : inner - 2].rstrip()
            return raw[:begin] + tag + b">" + _escaped(value) + b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">" + raw[end:] if value else raw
        return raw[:inner] + _escaped(value) + raw[_text_end(raw, inner) :]
    if op == "remove_element":
        if not node:
            raise ValueError("the root stays")
        return raw[:begin] + raw[_text_end(raw, end) :]
    if op == "insert_element":
        xml = e["xml"].encode()
        try:
            new = _places(xml, namespaces=True)[0]
        except ValueError as err:
            raise ValueError(f"the fragment is broken: {err}") from err
        part, where = xml[new[0] : new[3]], e.get("position") or "before"
        if where == "append-child":
            if empty:
                tag = raw[begin : inner - 2].rstrip()
                return raw[:begin] + tag + b">" + part + b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">" + raw[end:]
            return raw[:close] + part + raw[close:]
        if where not in ("before", "after") or not node:
            raise ValueError(f"no place {where!r}")
        at = begin if where == "before" else _text_end(raw, end)
        return raw[:at] + part + raw[at:]
    raise ValueError(f"unknown edit {op!r}")


_DECLARED = re.compile(rb"^<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")


def spliced(content: bytes, node: int, e: dict) -> bytes:
    """The document after one edit (a row of ``EDITS``) of the element with number ``node``; all other bytes stay.

    Raises ``ValueError`` if the edit lacks a field or has no place, or would break the document.
    """
    mark = next((m for m in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff") if content.startswith(m)), b"")
    body = content[len(mark) :]
    named = _DECLARED.match(body)
    code = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be", b"\xef\xbb\xbf": "utf-8"}.get(mark) or (named[1].decode() if named else "utf-8")
    try:
        raw = body.decode(code).encode()
        if raw.decode().encode(code) != body:
            raise ValueError("the encoding does not round-trip")
        out = _spliced(raw, node, e)
    except (UnicodeError, LookupError) as err:
        raise ValueError(f"encoding {code}: {err}") from err
    _places(out)  # an edit never leaves a broken document
    return mark + out.decode().encode(code, "xmlcharrefreplace")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """package, file, content, error: ``files`` (package, file, content) after ``edits`` (package, file and ``EDITS``).

    Edits follow ``seq``; a path must select exactly one element of the file as it is then.  A file is edited as
    a whole or, with ``error``, not at all; edits of a file that is not there give a row without content.
    """
    w = Window.partitionBy(*KEY).orderBy("seq")
    each = graph.cut(edits.withColumn("round", F.row_number().over(w)).drop("seq"))
    touched = each.select(*KEY).distinct()
    state = graph.cut(touched.join(files.select(*KEY, "content"), KEY, "left").select(*KEY, "content", F.col("content").alias("now"), F.when(F.col("content").isNull(), "no such file").alias("error")))
    rounds = each.agg(F.max("round")).first()[0] or 0
    fields = ["op", "xpath", "attr", "value", "xml", "position"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                now, error = r.now, r.error
                if r.op is not None and error is None:
                    try:
                        if r.bad is not None:
                            raise ValueError(f"{r.xpath!r}: {r.bad}")
                        if r.n != 1 or r.kind != "element":
                            raise ValueError(f"{r.xpath!r} selects {int(r.n)} nodes, one element is needed")
                        now = spliced(bytes(now), int(r.node_id), {f: getattr(r, f) for f in fields})
                    except ValueError as e:
                        error = str(e)
                rows.append((r.package, r.file, r.content, now, error))
            yield pd.DataFrame(rows, columns=[*KEY, "content", "now", "error"])

    for k in range(1, rounds + 1):
        step = each.where(F.col("round") == k).select(*KEY, *fields)
        live = state.where("error is null").join(step.select(*KEY), KEY, "left_semi")
        nodes = graph.cut(xml_nodes(live.select(*KEY, F.length("now").alias("length"), F.col("now").alias("content"))))
        found, bad = paths.select_nodes(nodes, step.select(*KEY, F.col("xpath").alias("path")))
        hits = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"), F.min("kind").alias("kind"))
        broken = nodes.where("error is not null").select(*KEY, F.col("error").alias("unread"))
        work = state.join(step, KEY, "left").join(hits, KEY, "left").join(broken, KEY, "left").join(bad.select(F.col("path").alias("xpath"), F.col("error").alias("bad")), "xpath", "left")
        work = work.select(*KEY, "content", "now", "error", *fields, F.coalesce("unread", "bad").alias("bad"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("node_id", F.lit(-1)).alias("node_id"), "kind")
        state = graph.cut(work.mapInPandas(run, "package string, file string, content binary, now binary, error string"))
    done = state.select(*KEY, F.when(F.col("error").isNull(), F.col("now")).otherwise(F.col("content")).alias("content"), "error")
    rest = files.join(touched, KEY, "left_anti").select(*KEY, "content", F.lit(None).cast("string").alias("error"))
    return done.unionByName(rest)


def _diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(candidate, diff): unified differences of the edited files, by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [[x.decode("utf-8", "replace").splitlines(keepends=True) for x in pair] for pair in zip(pdf["old"], pdf["content"], strict=True)]
            yield pd.DataFrame({"candidate": pdf["candidate"], "file": pdf["file"], "diff": ["".join(difflib.unified_diff(a, b, f"a/{f}", f"b/{f}")) for (a, b), f in zip(lines, pdf["file"], strict=True)], "source_lines": [len(a) for a, _ in lines]})

    each = after.join(before, ["candidate", "file"]).select("candidate", "file", "old", "content").mapInPandas(run, "candidate string, file string, diff string, source_lines int")
    return each.groupBy("candidate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "diff"))), lambda x: x["diff"]), "").alias("diff"), F.sum("source_lines").alias("source_lines"))


VERIFIED = "candidate string, accepted boolean, error string, before long, after long, cleared array<string>, introduced array<string>, diff string, source_lines long"
#: What the rules across files read of a file that a candidate does not edit.
_SHARED = "xpath like '/dmodule/identAndStatusSection/dmAddress/%' or tag in ('dmRefIdent', 'dmCode', 'issueInfo', 'graphic', 'symbol')"


def baseline(files: DataFrame, icns: DataFrame, accepted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What candidates of the packages in ``files`` are compared with: the node table, the findings of every single file, the keys of all findings."""
    nodes = graph.cut(xml_nodes(files))
    per_file = graph.cut(validation.file_findings(nodes, accepted))
    first = graph.cut(validation.first_copies(nodes.where("node_id = 0")))
    own = nodes.where("error is null").join(first, KEY, "left_semi")
    across = validation.cross_file(own, validation.data_modules(own), icns)
    return nodes, per_file, graph.cut(_keys(_counted_once(per_file, first).unionByName(across), F.col("package")))


def _counted_once(findings: DataFrame, first: DataFrame) -> DataFrame:
    """Findings of single files without those of byte-equal copies; a file that can't be read has no copy."""
    return findings.where("layer = 'L0'").unionByName(findings.where("layer <> 'L0'").join(first, KEY, "left_semi"))


def verify_candidates(files: DataFrame, icns: DataFrame, candidates: DataFrame, edits: DataFrame, accepted: tuple[str, ...] | None = None, as_sets: bool = False, base: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All candidates checked together: candidate, accepted, error, before, after, cleared, introduced, diff, source_lines.

    ``files``: package, file, length, content; ``candidates``: candidate (an id), package, target (``finding_key`` of
    the finding that it should clear; null: none); ``edits``: candidate, file and ``EDITS``.  A candidate is accepted
    if its edits apply, its target is among the findings that are gone, and no finding is new.  ``cleared`` and
    ``introduced`` are multiset differences of keys (differences of sets: ``as_sets``).  A candidate without edits, and one whose package or file is
    not there, is not accepted.  ``base``: the ``baseline`` of the files, where it is known.
    """
    own = graph.cut(candidates.select("candidate", F.col("package").alias("base"), "target"))
    edits = graph.cut(edits)
    if own.isEmpty():
        return own.sparkSession.createDataFrame([], VERIFIED)
    nodes, per_file, base_keys = base or baseline(files, icns, accepted)
    wanted = edits.select("candidate", "file").distinct()
    old = wanted.join(own, "candidate").join(files.select(F.col("package").alias("base"), "file", "content"), ["base", "file"]).select("candidate", "file", F.col("content").alias("old"))
    asked = edits.join(own.select("candidate"), "candidate", "left_semi").withColumnRenamed("candidate", "package")
    done = graph.cut(apply_edits(old.select(F.col("candidate").alias("package"), "file", F.col("old").alias("content")), asked))
    failed = done.where("error is not null").groupBy(F.col("package").alias("candidate")).agg(F.min("error").alias("error"))
    fresh = graph.cut(xml_nodes(done.where("error is null").select(*KEY, F.length("content").alias("length"), "content")))
    # the package as each candidate would leave it: its own files, and what it shares with the package
    kept = nodes.withColumnRenamed("package", "base").join(own.select("candidate", "base"), "base").join(wanted, ["candidate", "file"], "left_anti")
    same = kept.where(f"error is not null or ({_SHARED})").drop("base").withColumnRenamed("candidate", "package").select(*nodes.columns)
    overlay = graph.cut(same.unionByName(fresh))
    digests = kept.where("node_id = 0").select(F.col("candidate").alias("package"), "file", "digest").unionByName(fresh.where("node_id = 0").select(*KEY, "digest"))
    first = graph.cut(validation.first_copies(digests))
    sound = overlay.where("error is null").join(first, KEY, "left_semi")
    across = validation.cross_file(sound, validation.data_modules(sound), own.select(F.col("candidate").alias("package"), F.col("base")).join(icns.withColumnRenamed("package", "base"), "base").select("package", "ident"))
    changed = graph.cut(validation.file_findings(fresh, accepted))
    unchanged = per_file.withColumnRenamed("package", "base").join(own.select("candidate", "base"), "base").join(wanted, ["candidate", "file"], "left_anti").drop("base").withColumnRenamed("candidate", "package")
    unchanged = unchanged.select(*per_file.columns).unionByName(changed)
    after = graph.cut(_keys(_counted_once(unchanged, first).unionByName(across), F.col("package").alias("candidate")))
    before = base_keys.withColumnRenamed("package", "base").join(own.select("candidate", "base"), "base").select("candidate", "key")
    counts = before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(0))).groupBy("candidate", "key").agg(F.sum("side").alias("was"), F.sum(1 - F.col("side")).alias("is"))
    if as_sets:
        counts = counts.select("candidate", "key", F.least("was", F.lit(1)).alias("was"), F.least("is", F.lit(1)).alias("is"))
    times = lambda n: F.when(n > 0, F.array_repeat(F.col("key"), n.cast("int")))
    delta = counts.groupBy("candidate").agg(
        F.sum("was").alias("before"), F.sum("is").alias("after"),
        F.sort_array(F.flatten(F.collect_list(times(F.col("was") - F.col("is"))))).alias("cleared"), F.sort_array(F.flatten(F.collect_list(times(F.col("is") - F.col("was"))))).alias("introduced"),
    )
    none = F.array().cast("array<string>")
    out = own.join(failed, "candidate", "left").join(wanted.select("candidate").distinct().withColumn("has", F.lit(True)), "candidate", "left").join(delta, "candidate", "left")
    out = out.join(_diffs(old, done.where("error is null").select(F.col("package").alias("candidate"), "file", "content")), "candidate", "left")
    error = F.coalesce(F.col("error"), F.when(F.col("has").isNull(), F.lit("no edits")))
    out = out.withColumn("error", error).withColumn("cleared", F.coalesce("cleared", none)).withColumn("introduced", F.coalesce("introduced", none))
    good = F.col("error").isNull() & (F.size("introduced") == 0) & F.coalesce(F.col("target").isNull() | F.array_contains("cleared", F.col("target")), F.lit(False))
    bad = F.col("error").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("candidate", good.alias("accepted"), "error", zero("before"), F.when(bad, F.coalesce("before", F.lit(0))).otherwise(F.coalesce("after", F.lit(0))).alias("after"),
                      F.when(bad, none).otherwise(F.col("cleared")).alias("cleared"), F.when(bad, none).otherwise(F.col("introduced")).alias("introduced"), "diff", "source_lines")


def _keys(findings: DataFrame, *names: Column) -> DataFrame:
    """The names and ``key`` of findings, which have no path."""
    return findings.withColumn("path", F.lit(None).cast("string")).select(*names, finding_key().alias("key"))


def risk_tier(rule: Column) -> Column:
    """Whether repairs of a rule's findings may be applied after approval; an unknown rule's may not."""
    return F.when(rule.isin(*APPLICABLE), "apply-eligible").otherwise("dry-run-only")


REPLY = f"edits array<struct<file:string,{EDITS.replace(', ', ',').replace(' ', ':')}>>, rationale string, tokens long"


def repair_rounds(files: DataFrame, icns: DataFrame, findings: DataFrame, act: Callable[[dict, list[str]], dict], iterations: int = 12, tokens: int = 60_000, no_progress: int = 3, base: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Proposed patches of findings, all findings a round: the findings' columns, status, edits, diff, cleared, iterations, tokens_used, said, source_lines.

    ``findings``: as ``validate`` gives them; ``act`` maps a finding (its columns and ``key``) and what was said about
    earlier tries to a reply: ``edits`` (dicts with file and the fields of ``EDITS``), ``rationale``, ``tokens``.  It runs
    where the findings are.  A try is verified by ``verify_candidates`` with all others of its round and may only
    touch the finding's own file.  Status: ``patched``; ``refused`` if the same was said ``no_progress`` times on end;
    ``budget-exhausted`` if iterations or tokens are used up; a patch of a rule that is not applicable becomes
    ``dry-run-only``.
    """
    cols = findings.columns
    keyed = _keys(findings, *[F.col(c) for c in cols])
    state = graph.cut(keyed.withColumn("candidate", F.sha2(F.concat_ws("|", F.col("package"), F.col("key")), 256)).dropDuplicates(["candidate"]).select(
        "candidate", *cols, "key", F.array().cast("array<string>").alias("said"), F.lit(0).cast("long").alias("spent"), F.lit("open").alias("status"), F.lit(0).alias("n"),
        F.lit(None).cast("string").alias("diff"), F.lit(None).cast("int").alias("source_lines"), F.array().cast("array<string>").alias("cleared"), F.lit(None).cast(f"struct<{REPLY}>").alias("reply")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [json.dumps(act({k: r[k] for k in [*cols, "key"]}, list(r["said"]))) for r in pdf.to_dict("records")]
            yield pd.DataFrame({"candidate": pdf["candidate"], "answer": out})

    for k in range(1, iterations + 1):
        live = state.where("status = 'open'")
        if live.isEmpty():
            break
        said = graph.cut(live.select("candidate", *cols, "key", "said").mapInPandas(run, "candidate string, answer string").select("candidate", F.from_json("answer", REPLY).alias("new")))
        tries = said.join(live.select("candidate", "package", "key", F.col("file").alias("own")), "candidate")
        each = tries.select("candidate", "own", F.posexplode("new.edits").alias("at", "e")).select("candidate", "own", "at", "e.*")
        strange = each.where(~F.col("file").eqNullSafe(F.col("own"))).select("candidate").distinct().withColumn("strange", F.lit(True))
        base = base or baseline(files, icns)
        checked = verify_candidates(files, icns, tries.join(strange, "candidate", "left_anti").select("candidate", "package", F.col("key").alias("target")), each.join(strange, "candidate", "left_anti").select("candidate", "file", F.coalesce("seq", F.col("at") + 1).alias("seq"), "op", "xpath", "attr", "value", "xml", "position"), base=base)
        checked = checked.select("candidate", "accepted", F.col("error").alias("why"), "introduced", F.col("cleared").alias("gone"), F.col("diff").alias("made"), F.col("source_lines").alias("lines"))
        now = state.join(said, "candidate", "left").join(checked, "candidate", "left").join(strange, "candidate", "left")
        tried, spent = F.col("status") == "open", F.col("spent") + F.coalesce("new.tokens", F.lit(0))
        good = F.coalesce("accepted", F.lit(False))
        complaint = F.when(F.col("strange"), "a patch may only touch its finding's own file").when(F.col("new.edits").isNull(), "no edits").when(F.col("why").isNotNull(), F.col("why")).otherwise(
            F.concat(F.lit("target cleared: "), F.array_contains("gone", F.col("key")).cast("string"), F.lit("; introduced: "), F.array_join("introduced", ", ")))
        after = F.when(good | ~tried, F.col("said")).otherwise(F.array_append("said", complaint))
        recent = F.slice(after, F.greatest(F.size(after) - no_progress + 1, F.lit(1)), no_progress)
        stuck = (F.size(after) >= no_progress) & (F.size(F.array_distinct(recent)) == 1)
        status = F.when(spent > tokens, "budget-exhausted").when(good & (risk_tier(F.col("rule_id")) == "dry-run-only"), "dry-run-only").when(good, "patched").when(stuck, "refused").when(F.lit(k == iterations), "budget-exhausted").otherwise("open")
        kept = tried & good & (spent <= tokens)
        new = lambda name, value: F.when(kept, value).otherwise(F.col(name)).alias(name)
        state = graph.cut(now.select("candidate", *cols, "key", after.alias("said"), F.when(tried, spent).otherwise(F.col("spent")).alias("spent"), F.when(tried, status).otherwise(F.col("status")).alias("status"),
                                     (F.col("n") + tried.cast("int")).alias("n"), new("diff", F.col("made")), new("source_lines", F.col("lines").cast("int")), new("cleared", F.col("gone")), F.when(tried, F.col("new")).otherwise(F.col("reply")).alias("reply")))
    patched = F.col("status").isin("patched", "dry-run-only")
    return state.select(*cols, "key", "status", F.when(patched, F.col("reply.edits")).alias("edits"), "reply.rationale", "diff", "cleared", "source_lines", F.col("n").alias("iterations"), F.col("spent").alias("tokens_used"), "said")


def apply_gate(files: DataFrame, icns: DataFrame, patches: DataFrame, approvals: DataFrame, base: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """What may be written, and what became of each patch.

    ``patches``: of ``repair_rounds``; ``approvals``: package, key.  The tier is taken from the rule again, whatever the
    patch says.  The approved patches of a package are verified together: if they would bring any finding that
    was not there, none of them is written.  First result: package, file, digest (md5 of the bytes that were
    verified), content.  Second: the patches with the status ``applied``, ``declined`` or as it was.
    """
    able = patches.where((risk_tier(F.col("rule_id")) == "apply-eligible") & (F.col("status") == "patched")).select("package", "key", "edits")
    agreed = graph.cut(able.join(approvals.select("package", "key").distinct(), ["package", "key"]))
    order = Window.partitionBy("package", "file").orderBy("key", "at")
    each = agreed.select("package", "key", F.posexplode("edits").alias("at", "e")).select("package", "key", "at", "e.*").withColumn("seq", F.row_number().over(order))
    each = graph.cut(each.select(F.col("package").alias("candidate"), "file", "seq", "op", "xpath", "attr", "value", "xml", "position"))
    asked = agreed.select(F.col("package").alias("candidate"), "package", F.lit(None).cast("string").alias("target")).distinct()
    good = graph.cut(verify_candidates(files, icns, asked, each, as_sets=True, base=base).where("accepted").select(F.col("candidate").alias("package")))
    own = files.join(good, "package", "left_semi").join(each.select(F.col("candidate").alias("package"), "file").distinct(), KEY, "left_semi")
    edited = apply_edits(own.select(*KEY, "content"), each.withColumnRenamed("candidate", "package").join(good, "package", "left_semi"))
    written = edited.join(own.select(*KEY, F.md5("content").alias("digest")), KEY).select(*KEY, "digest", "content")
    fate = agreed.select("package", "key").withColumn("agreed", F.lit(True)).join(good.withColumn("good", F.lit(True)), "package", "left")
    eligible = (risk_tier(F.col("rule_id")) == "apply-eligible") & (F.col("status") == "patched")
    status = F.when(eligible & F.col("good"), "applied").when(eligible & F.col("agreed").isNull(), "declined").otherwise(F.col("status"))
    return written, patches.join(fate, ["package", "key"], "left").withColumn("status", status).select(*patches.columns)
