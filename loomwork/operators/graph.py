"""A typed hypergraph of nodes, hyperedges with members, and edges: traversal, impact of changes, export.

Traversals go level by level; each level joins the edges with the frontier only and is settled, so that plans stay short.  The
number of levels is a parameter; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settled import forget, settle


def undirected(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(src, dst, kind) in both directions."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return e.select("src", "dst", "kind").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def _walk(first: DataFrame, depth: int, step) -> DataFrame:
    """Levels from the first on: ``step`` makes the next one of the last, without the nodes seen.  A level is settled by itself, and
    all levels as one table at the end."""
    found = [settle(first.withColumn("level", F.lit(0)), "level")]
    for level in range(1, depth + 1):
        new = step(found[-1])
        for seen in found:
            new = new.join(seen.select("id"), "id", "left_anti")
        new = settle(new.withColumn("level", F.lit(level)), "level")
        if new.isEmpty():
            break
        found.append(new)
    out = settle(_union(found), "levels")
    forget(first.sparkSession, *found)
    return out


def levels(seeds: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """(id, level): nodes within ``depth`` steps of the seeds, each with its least level."""
    both = undirected(edges, kinds).select("src", "dst")
    step = lambda last: both.join(last.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
    return _walk(seeds.select("id").distinct(), depth, step)


def touched_edges(reached: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """Edges that a traversal used: an end is nearer than ``depth``."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    near = reached.where(F.col("level") < depth).select(F.col("id"))
    by = lambda end: e.join(near, e[end] == near["id"], "left_semi")
    return by("src").select("src", "dst", "kind").union(by("dst").select("src", "dst", "kind")).distinct()


def member_selected(role: Column, required: Column, include: Column, exclude: Column, include_optional: bool = True) -> Column:
    """A hyperedge's policy: optional members only if wanted; a list of roles admits only these, another excludes."""
    ok = F.coalesce(required, F.lit(True)) | F.lit(include_optional)
    ok = ok & (F.coalesce(F.size(include) <= 0, F.lit(True)) | F.coalesce(F.array_contains(include, role), F.lit(False)))
    return ok & ~F.coalesce(F.array_contains(exclude, role), F.lit(False))


def expand_members(active: DataFrame, members: DataFrame, policies: DataFrame | None = None, include_optional: bool = True) -> DataFrame:
    """(hyperedge_id, node_id, role, reason) of the selected members of active hyperedges."""
    rows = members.join(active.select("hyperedge_id").distinct(), "hyperedge_id", "left_semi")
    if policies is not None:
        rows = rows.join(policies, "hyperedge_id", "left")
        rows = rows.where(member_selected(F.col("role"), F.col("required"), F.col("include_roles"), F.col("exclude_roles"), include_optional))
    elif not include_optional:
        rows = rows.where(F.coalesce("required", F.lit(True)))
    return rows.select("hyperedge_id", "node_id", "role", F.concat(F.lit("member of strand "), F.col("hyperedge_id").cast("string")).alias("reason")).distinct()


def hops(reasons: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """(id, reason, level): nodes reached from those in ``reasons`` (id, reason), with the least reason of their level."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    step = e.select("src", F.col("dst").alias("to"), "kind").union(e.select(F.col("dst").alias("src"), F.col("src").alias("to"), "kind"))

    def further(last: DataFrame) -> DataFrame:
        why = F.concat(F.col("kind"), F.lit(" relationship from "), F.col("src").cast("string"))
        return step.join(last.select(F.col("id").alias("src")), "src").groupBy(F.col("to").alias("id")).agg(F.min(why).alias("reason"))

    return _walk(reasons.select("id", "reason"), depth, further)


def impact(changes: DataFrame, nodes: DataFrame, members: DataFrame, edges: DataFrame, depth: int = 1, kinds: list[str] | None = None, policies: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a change set reaches: ``direct`` nodes, ``active`` hyperedges, ``members`` of these, ``reached`` nodes with reasons,
    ``related`` nodes that no hyperedge shows, and ``unmatched`` changes.

    changes: (path, old_path, whole_file, ranges); nodes: (id, path, line_start, line_end, watch).
    """
    from .intervals import changed

    by_path = changes.withColumn("path", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path"))))).select("path", F.col("path").alias("changed_path"), "whole_file", "ranges")
    at = {"watch": F.col("watch"), "start": F.col("line_start"), "end": F.col("line_end")}
    hit = by_path.join(nodes, "path").where(changed(at, {"whole_file": F.col("whole_file"), "ranges": F.col("ranges")}))
    direct = settle(hit.groupBy("id").agg(F.max(F.concat(F.lit("file change in "), F.col("changed_path"))).alias("reason"), F.max("path").alias("path")))
    active = members.join(direct.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("hyperedge_id").distinct()
    active = settle(active.withColumn("direct", F.lit(True)))
    shown = expand_members(active, members, policies)
    start = direct.select("id", "reason").union(shown.groupBy(F.col("node_id").alias("id")).agg(F.min("reason").alias("reason")).join(direct, "id", "left_anti"))
    reached = hops(start, edges, depth, kinds)
    later = members.join(reached.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("hyperedge_id").distinct().join(active, "hyperedge_id", "left_anti")
    every = active.union(later.withColumn("direct", F.lit(False)))
    all_members = expand_members(every, members, policies)
    related = reached.join(all_members.select(F.col("node_id").alias("id")), "id", "left_anti")
    unmatched = changes.select("path").join(hit.select(F.col("changed_path").alias("path")).distinct(), "path", "left_anti")
    return {"direct": direct, "active": every, "members": all_members, "reached": reached, "related": related, "unmatched": unmatched}


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a DOT graph's nodes and edges; the text between the braces when ordered by both."""
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.col("label")), F.lit("];")).alias("line"))
    arrow = F.when(F.col("bidirectional"), " [dir=both, label=").otherwise(" [label=")
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), arrow, _quoted(F.col("kind")), F.lit("];")).alias("line"))
    return n.union(e)


def context(seeds: DataFrame, named: DataFrame, members: DataFrame, edges: DataFrame, depth: int = 1, kinds: list[str] | None = None, any_search: bool = False) -> dict[str, DataFrame]:
    """What surrounds explicit seeds: ``reached`` nodes, ``active`` hyperedges, and ``members`` shown.

    seeds: (id, reason, from_search); named: (hyperedge_id).  Policies don't apply here.  Only named hyperedges and those of
    seeds that weren't found by search are expanded; hyperedges met on the way are expanded only where no seed came from
    search (``any_search`` false); others show the members that were reached anyway.  Only named hyperedges are direct.
    """
    of = lambda ids: members.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("hyperedge_id").distinct()
    expanded = settle(named.select("hyperedge_id").union(of(seeds.where("NOT from_search"))).distinct())
    start = seeds.groupBy("id").agg(F.min("reason").alias("reason"))
    shown = expand_members(expanded, members)
    start = start.union(shown.groupBy(F.col("node_id").alias("id")).agg(F.min("reason").alias("reason")).join(start, "id", "left_anti"))
    reached = hops(start, edges, depth, kinds)
    if not any_search:
        expanded = settle(expanded.union(of(reached)).distinct())
        shown = expand_members(expanded, members)
        more = shown.groupBy(F.col("node_id").alias("id")).agg(F.min("reason").alias("reason")).join(reached, "id", "left_anti")
        reached = reached.union(more.withColumn("level", F.lit(depth)))
    active = of(reached).union(expanded).distinct().join(named.select("hyperedge_id", F.lit(True).alias("direct")).distinct(), "hyperedge_id", "left")
    active = active.select("hyperedge_id", F.coalesce("direct", F.lit(False)).alias("direct"))
    listed = members.join(reached.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("hyperedge_id", "node_id", "role")
    return {"reached": reached, "active": active, "members": listed.union(shown.select("hyperedge_id", "node_id", "role")).distinct()}


def merged_packets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results (hyperedge_id, node_id, role, direct, reason) as one: direct if either says so, the first one's reason."""
    x, y = a.alias("x"), b.alias("y")
    on = (F.col("x.hyperedge_id") == F.col("y.hyperedge_id")) & (F.col("x.node_id") == F.col("y.node_id")) & F.col("x.role").eqNullSafe(F.col("y.role"))
    either = lambda c: F.coalesce(f"x.{c}", f"y.{c}").alias(c)
    direct = (F.coalesce("x.direct", F.lit(False)) | F.coalesce("y.direct", F.lit(False))).alias("direct")
    return x.join(y, on, "full").select(either("hyperedge_id"), either("node_id"), either("role"), direct, either("reason"))
