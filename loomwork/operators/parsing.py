"""Annotations in source text, and unified diffs, as table-valued operators.

Parsing is a small Python helper over Arrow batches; everything after it is joins and grouping.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: what ends an annotation, and lines that a node annotation reaches over
CLOSERS, GAP = ("*/", "-->", "*)", "-/", "-}", "#>"), 3
_MARK = re.compile(r"(?<![\w@])@(anchor|strand|relation)\b")
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ROW = "path string, line int, what string, id string, kind string, role string, target string, intent string, required boolean, error string"


def _body(text: str) -> str:
    """What stands before the end of the comment; quotes hide it, and a backslash in double quotes the next character."""
    quote, skip = "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\" and quote == '"'
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif any(text.startswith(x, i) for x in CLOSERS):
            return text[:i].strip()
    return text.strip()


def lines_of(text: str) -> list[str]:
    """Lines end at a line feed, with or without a carriage return before it, and at nothing else."""
    lines = re.split(r"\r?\n", text)
    return lines[:-1] if lines[-1] == "" else lines


def scan_annotations(path: str, text: str) -> list[dict]:
    """Rows for nodes, hyperedges with an intent, members and edges; a member binds to a node up to three lines above it."""
    rows: list[dict] = []
    active, active_line = None, -GAP - 1
    for n, line in enumerate(lines_of(text), 1):
        marks = list(_MARK.finditer(line))
        for i, m in enumerate(marks):
            end = marks[i + 1].start() if i + 1 < len(marks) else len(line)
            row = {"path": path, "line": n, "what": "error"}
            try:
                words = shlex.split(_body(line[m.end() : end]))
                if not words or "=" in words[0]:
                    raise ValueError("a name is missing")
                pairs = dict(w.split("=", 1) for w in words[1:])
            except ValueError as e:
                rows.append(row | {"error": str(e)})
                continue
            if n - active_line > GAP:
                active = None
            if m[1] == "anchor":
                if "description" in pairs:
                    rows.append(row | {"id": words[0], "error": "description isn't allowed on an anchor"})
                    continue
                active, active_line = words[0], n
                rows.append(row | {"what": "node", "id": words[0], "kind": pairs.get("kind"), "target": pairs.get("tags")})
            elif m[1] == "strand":
                if pairs.get("intent"):
                    rows.append(row | {"what": "hyperedge", "id": words[0], "intent": pairs["intent"]})
                rows.append(row | {"what": "member", "id": words[0], "role": pairs.get("role"), "target": active or f"source:{path}", "required": pairs.get("required", "true").lower() != "false"})
            elif active is None or "to" not in pairs:
                rows.append(row | {"error": "a relation needs an anchor and a target"})
            else:
                rows.append(row | {"what": "edge", "id": active, "kind": words[0], "target": pairs["to"]})
    return rows


_ESCAPE = re.compile(r"\\([0-7]{1,3}|.)", re.S)
# fixed values: what git writes after a backslash for characters that can't stand in a name
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def path_name(text: str, prefix: str = "") -> str | None:
    """A path as a patch names it: quoted like a C string if need be, /dev/null for none."""
    text = text.split("\t")[0].strip() if not text.startswith('"') else text.strip()
    if text == "/dev/null":
        return None
    if len(text) > 1 and text[0] == text[-1] == '"':
        octal = lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else _ESCAPED.get(m[1], m[1])
        plain = _ESCAPE.sub(octal, text[1:-1])
        try:  # octal escapes are the bytes of UTF-8
            text = plain.encode("latin-1").decode()
        except UnicodeError:
            text = plain
    return text.removeprefix(prefix)


def _header_names(text: str) -> tuple[str | None, str | None]:
    """Both names of a header; without quotes the cut is where they agree, or at the first " b/"."""
    if '"' in text:
        found = re.findall(r'"(?:[^"\\]|\\.)*"|\S+', text)
        return (path_name(found[0], "a/"), path_name(found[-1], "b/")) if len(found) > 1 else (None, None)
    cuts = [m.start() for m in re.finditer(" b/", text)]
    for at in cuts:
        if text[:at].removeprefix("a/") == text[at + 3 :]:
            return text[at + 3 :], text[at + 3 :]
    return (text[: cuts[0]].removeprefix("a/"), text[cuts[0] + 3 :]) if cuts else (None, None)


def scan_patch(text: str) -> list[dict]:
    """Rows for changed files, their new line ranges and removed lines; headers count outside hunks only.

    A file is added, deleted, renamed, copied or modified; its old path is given unless it is added or modified.
    """
    rows: list[dict] = []
    file: dict = {}
    before = after = at_old = 0

    def place() -> str | None:
        return file.get("to") or file.get("new") or file.get("from") or file.get("old")

    def close() -> None:
        if place():
            moved = next((x for x in ("renamed", "copied") if file.get(x)), None)
            status = moved or ("deleted" if not file["new"] else "added" if not file["old"] else "modified")
            old = file["from"] if moved else file["old"] if status == "deleted" else None
            rows.append({"what": "file", "path": place(), "old_path": old, "status": status, "whole_file": not file["ranges"]})

    for line in lines_of(text):
        if before > 0 or after > 0:
            if line.startswith("-"):
                rows.append({"what": "removed", "path": place(), "line_start": at_old, "line_end": at_old, "text": line[1:]})
                before, at_old = before - 1, at_old + 1
            elif line.startswith("+"):
                after -= 1
            elif not line.startswith("\\"):
                before, after, at_old = before - 1, after - 1, at_old + 1
        elif line.startswith("diff --git "):
            close()
            old, new = _header_names(line[11:])
            file = {"old": old, "new": new, "ranges": 0}
        elif m := re.match(r"(rename|copy) (from|to) (.*)", line):
            file |= {m[2]: path_name(m[3]), {"rename": "renamed", "copy": "copied"}[m[1]]: True}
        elif line.startswith("new file mode"):
            file["old"] = None
        elif line.startswith("deleted file mode"):
            file["new"] = None
        elif line.startswith("--- "):
            file = {"new": None, "ranges": 0} | file | {"old": path_name(line[4:], "a/")}
        elif line.startswith("+++ "):
            file = {"old": None, "ranges": 0} | file | {"new": path_name(line[4:], "b/")}
        elif m := _HUNK.match(line):
            at_old, before, start, after = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            file["ranges"] = file.get("ranges", 0) + 1
            start = max(start, 1)
            rows.append({"what": "range", "path": place(), "line_start": start, "line_end": start + max(after, 1) - 1})
    close()
    return rows


def _arrow(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])


def annotations(files: DataFrame) -> DataFrame:
    """All annotations of files (path, text)."""
    schema = _arrow(_ROW)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in scan_annotations(p or "", t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "text").mapInArrow(scan, _ROW)


_PATCH = "patch_id string, what string, path string, old_path string, status string, whole_file boolean, line_start int, line_end int, text string"


def patches(texts: DataFrame) -> DataFrame:
    """What patches (patch_id, text) say: files with their status, ranges and removed lines."""
    schema = _arrow(_PATCH)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"patch_id": p} | r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in scan_patch(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.select("patch_id", "text").mapInArrow(scan, _PATCH)
