"""Markdown of bounded results: excerpts that fit a budget, and hyperedges with their members."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def fence(text: str) -> str:
    """A code fence longer than any run of backticks in the text."""
    return "`" * max(3, 1 + max((len(x) for x in re.findall("`+", text)), default=0))


def location(path: str, start: int | None = None, end: int | None = None) -> str:
    if start is None:
        return path
    return f"{path}#L{start}" + (f"-L{end}" if end is not None and end != start else "")


def packet(excerpts: DataFrame, members: DataFrame | None = None, k: int = 64) -> str:
    """excerpts: (path, start, end, language, source, ord), bounded by a budget before; members: (hyperedge_id, node_id, role).

    At most ``k`` rows of each are printed, and how many were left out is said.
    """
    out = []
    rows = excerpts.orderBy("ord", "path", "start").limit(k + 1).collect()
    for r in rows[:k]:
        f = fence(r["source"])
        out.append(f"### {location(r['path'], r['start'], r['end'])}\n\n{f}{r['language'] or ''}\n{r['source']}\n{f}\n")
    if len(rows) > k:
        out.append(f"{excerpts.count() - k} more excerpts\n")
    if members is not None:
        for r in members.orderBy("hyperedge_id", "node_id", "role").limit(k).collect():
            out.append(f"- {r['hyperedge_id']}: {r['node_id']}" + (f" ({r['role']})" if r["role"] else ""))
    return "\n".join(out)
