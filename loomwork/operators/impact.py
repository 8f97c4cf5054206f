"""What a change set reaches, as one plan: declarations and lines that changed, declarations that were deleted, hyperedges with
their policies, and bounded steps along edges.

Every writer of a reason has a rank (``RANKS``) and a place within it, and a node's reason is the last writer's; reasons of deleted
annotations give way to all others.  Depth and followed kinds are data of the hyperedges: the depth is the largest one among the
hyperedges that are hit, unless the caller names one, and an edge is followed if its owner's policy follows its kind.

Traversal goes level by level.  A level is settled by itself; what was seen is the union of the levels, so nothing is written
twice, and what no result reads is deleted at the end.  Only the depth, one number, comes to the driver.

The whole graph is shuffled as seldom as may be.  Declarations and nodes meet the changed paths through a sieve before they are
joined.  Members are dealt by hyperedge once: those that active hyperedges show, and those of others, which later levels look
through.  Edges with both ends among what the first level has seen take no part in later ones.

nodes        (id, path, line_start, line_end, watch, source, declared_in, declared_at)
hyperedges   (id, tags, include_roles, exclude_roles, follow_relations, depth, source, declared_in, declared_at)
members      (seq, hyperedge_id, node_id, role, required, source, declared_in, declared_at)
edges        (seq, owner, src, dst, kind, source, declared_in, declared_at)
changes      (ord, path, old_path, status, whole_file, ranges)
removed      (path, line, text)

``source`` is sidecar or annotation, ``declared_in`` and ``declared_at`` are its file and line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import forget, settle
from .graph import member_selected
from .parsing import annotations

#: Later writers overwrite earlier ones; the first one, deleted annotations, overwrites nothing.
PARTS = ("reasons", "strands", "members", "related", "unmatched")
RANKS = ("annotation removed", "membership", "relation", "node", "file", "sidecar strand", "sidecar anchor", "sidecar relation")
_DECLARED = ["source", "declared_in", "declared_at"]
_MEMBER = "struct<anchor:string,role:string,required:boolean>"
_RELATION = "struct<from:string,to:string,kind:string>"
#: A deleted declaration file that is a JSON document of these lists.
SIDECAR = f"struct<strands:array<struct<id:string,tags:array<string>,on_change:struct<include_roles:array<string>,exclude_roles:array<string>>,members:array<{_MEMBER}>,relations:array<{_RELATION}>>>,anchors:array<struct<id:string>>,relations:array<{_RELATION}>>"


#: Words of 64 bits in a sieve of keys; more keys let more rows through, which the join drops.
WORDS = 1 << 19


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    hyperedges: DataFrame
    members: DataFrame
    edges: DataFrame


def _paths(changes: DataFrame) -> DataFrame:
    """Changed files by each path that they have or had."""
    return changes.withColumn("at", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))))


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS))


def _marks(key: Column) -> Column:
    """Three bits of a key's word."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int")) for i in (1, 2, 3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits) of keys: at most ``WORDS`` rows, however many keys there are."""
    return keys.groupBy(_word(F.col(key)).alias("_word")).agg(F.bit_or(_marks(F.col(key))).alias("_bits"))


def sifted(df: DataFrame, key: str, through: DataFrame) -> DataFrame:
    """Rows whose key may be among those of a sieve, none that is being lost; null is no key."""
    own = _marks(F.col(key))
    rows = df.where(F.col(key).isNotNull()).withColumn("_word", _word(F.col(key))).join(F.broadcast(through), "_word")
    return rows.where(F.col("_bits").bitwiseAND(own) == own).select(*df.columns)


def _touched(declared: DataFrame, first: DataFrame) -> DataFrame:
    """Declarations that changed, with the changed path: by the first changed file of theirs, an annotation by its line only."""
    on_line = F.col("_f.whole_file") | F.exists("_f.ranges", lambda r: F.col("declared_at").between(r["start"], r["end"]))
    hit = (F.col("source") == "sidecar") | ((F.col("source") == "annotation") & F.col("declared_at").isNotNull() & on_line)
    return declared.join(first, "declared_in").where(hit).withColumn("changed_path", F.col("_f.path")).drop("_f")


def _reason(rank: str, text: Column, place: Column) -> list[Column]:
    return [text.alias("reason"), F.struct(F.lit(RANKS.index(rank)).alias("rank"), place.cast("long").alias("place")).alias("precedence")]


@dataclass
class Removed:
    """What deleted declarations say: nodes with reasons, seeds, members, edges, hyperedges with their tags, and files that matched."""

    reasons: DataFrame
    seeds: DataFrame
    members: DataFrame
    edges: DataFrame
    hyperedges: DataFrame
    matched: DataFrame


def removed_declarations(changes: DataFrame, removed: DataFrame) -> Removed:
    """Removed lines of a file are joined again; a deleted file that parses as declarations counts as such, all else is searched
    for annotations.  A file's removed lines are bounded by its patch."""
    lines = F.array_sort(F.collect_list(F.struct("line", "text")))
    whole = removed.groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    gone = _paths(changes.where("status = 'deleted'")).select(F.col("at").alias("path")).distinct().withColumn("_gone", F.lit(True))
    parsed = F.from_json("text", SIDECAR, {"mode": "PERMISSIVE"})
    known = F.size(F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))) > 0
    whole = whole.join(gone, "path", "left").withColumn("doc", F.when(F.coalesce("_gone", F.lit(False)) & known, parsed))
    whole = settle(whole.select("path", "text", "doc"), "removed")
    side = whole.where("doc IS NOT NULL")
    strands = side.select("path", F.posexplode("doc.strands").alias("i", "s"))
    side_members = strands.select("path", "i", F.col("s.id").alias("hyperedge_id"), F.posexplode("s.members").alias("j", "m"))
    side_nodes = side.select("path", F.posexplode("doc.anchors").alias("i", "a"))
    side_edges = side.select("path", F.posexplode("doc.relations").alias("i", "r"))
    strand_edges = strands.select("path", F.explode("s.relations").alias("r"))
    found = settle(annotations(whole.where("doc IS NULL")), "annotations")
    at = found.where("what = 'member' AND id IS NOT NULL")
    place = lambda *c: F.row_number().over(Window.partitionBy("node_id").orderBy(*c))
    why = lambda what, path="path": F.concat(F.lit(f"{what} metadata removed from "), F.col(path))
    reasons = [
        at.select(F.col("target").alias("node_id"), "path", "line").withColumn("p", -place("path", "line")).select("node_id", *_reason("annotation removed", F.concat(F.lit("annotation removed from "), "path"), F.col("p"))),
        side_members.select(F.col("m.anchor").alias("node_id"), "path", "i", "j").withColumn("p", place("path", "i", "j")).select("node_id", *_reason("sidecar strand", why("strand"), F.col("p"))),
        side_nodes.select(F.col("a.id").alias("node_id"), "path", "i").withColumn("p", place("path", "i")).select("node_id", *_reason("sidecar anchor", why("anchor"), F.col("p"))),
        side_edges.select("path", "i", F.explode(F.array("r.from", "r.to")).alias("node_id")).withColumn("p", place("path", "i")).select("node_id", *_reason("sidecar relation", why("relationship"), F.col("p"))),
    ]
    every = reasons[0]
    for more in reasons[1:]:
        every = every.union(more)
    members = side_members.select("hyperedge_id", F.col("m.anchor").alias("node_id"), "m.role", F.coalesce("m.required", F.lit(True)).alias("required"))
    members = members.union(at.select(F.col("id").alias("hyperedge_id"), F.col("target").alias("node_id"), "role", F.coalesce("required", F.lit(True))))
    none = F.array().cast("array<string>")
    empty = [none, none, none]
    hyperedges = strands.select(F.col("s.id").alias("id"), *[F.coalesce(c, none) for c in ("s.tags", "s.on_change.include_roles", "s.on_change.exclude_roles")])
    hyperedges = hyperedges.union(at.select("id", *empty)).union(found.where("what = 'hyperedge'").select("id", *empty)).toDF("id", "tags", "include_roles", "exclude_roles")
    hyperedges = hyperedges.groupBy("id").agg(*[F.max(c).alias(c) for c in ("tags", "include_roles", "exclude_roles")])
    edges = strand_edges.select("r.from", "r.to", "r.kind").union(side_edges.select("r.from", "r.to", "r.kind")).toDF("src", "dst", "kind")
    seeds = strands.select(F.col("s.id").alias("hyperedge_id")).union(at.select("id")).distinct()
    matched = side.select("path").union(at.select("path")).distinct()
    return Removed(every, seeds, members, edges, hyperedges, matched)


def impact(graph: Graph, changes: DataFrame, removed: DataFrame | None = None, depth: int | None = None, kinds: list[str] | None = None, default_depth: int = 1, default_kinds: list[str] | None = None, tags: list[str] = (), include_optional: bool = True, parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """``reasons`` (id, reason, direct), ``strands`` (hyperedge_id, direct), ``members`` (hyperedge_id, node_id, role, reason, direct),
    ``related`` (id, reason, direct): nodes that no hyperedge shows, and ``unmatched`` (path).

    ``kinds`` replaces the policies of hyperedges and the default kinds; ``depth`` replaces their depths and the default.  Only the
    ``parts`` that are asked for are made.
    """
    spark, made = changes.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(settle(df, name))
        return made[-1]

    removed = removed if removed is not None else spark.createDataFrame([], "path string, line int, text string")
    gone = removed_declarations(changes, removed)
    of_file = _paths(changes).select(F.col("at"), "ord", F.col("path").alias("changed_path"), "whole_file", "ranges")
    paths = kept(sieve(of_file, "at"), "sieve")
    first = _paths(changes).groupBy(F.col("at").alias("declared_in")).agg(F.min_by(F.struct("path", "whole_file", "ranges"), "ord").alias("_f"))
    hit_members, hit_edges, hit_nodes, hit_strands = (kept(_touched(sifted(df, "declared_in", paths), first), name) for df, name in ((graph.members, "members"), (graph.edges, "edges"), (graph.nodes.select("id", *_DECLARED), "nodes"), (graph.hyperedges.select("id", *_DECLARED), "hyperedges")))
    here = F.coalesce("declared_in", F.lit("sidecar"))
    at = F.coalesce(F.col("watch"), F.lit("file")) == "file"
    lines = F.exists("ranges", lambda r: (r["start"] <= F.coalesce("line_end", "line_start")) & (F.col("line_start") <= r["end"]))
    hit_files = sifted(graph.nodes, "path", paths).join(of_file, F.col("path") == F.col("at")).where(F.col("whole_file") | at | F.col("line_start").isNull() | lines)
    hit_files = kept(hit_files.select("id", "ord", "changed_path"), "files")
    reasons = [
        hit_members.select(F.col("node_id").alias("id"), *_reason("membership", F.concat(F.lit("metadata changed in "), here), F.col("seq"))),
        hit_edges.select(F.explode(F.array("src", "dst")).alias("id"), *_reason("relation", F.concat(F.lit("relationship metadata changed in "), here), F.col("seq"))),
        hit_nodes.select("id", *_reason("node", F.concat(F.lit("anchor metadata changed in "), here), F.lit(0))),
        hit_files.select("id", *_reason("file", F.concat("changed_path", F.lit(" changed")), F.col("ord"))),
        gone.reasons.withColumnRenamed("node_id", "id"),
    ]
    every = reasons[0]
    for more in reasons[1:]:
        every = every.unionByName(more)
    last = F.max(F.struct("precedence", "reason"))  # of equal places the largest text, so that repeated rows have one result
    direct = kept(every.groupBy("id").agg(last["reason"].alias("reason")), "direct")
    matched = gone.matched
    for df in (hit_members, hit_edges, hit_nodes, hit_strands, hit_files):
        matched = matched.union(df.select(F.col("changed_path").alias("path")))
    out = {}
    if "unmatched" in parts:
        out["unmatched"] = settle(changes.select("path").join(matched.distinct(), "path", "left_anti"), "unmatched")
    if set(parts) <= {"unmatched"}:
        forget(spark, *made)
        return out

    known = graph.hyperedges.select(F.col("id").alias("hyperedge_id"), "tags")
    wanted = lambda df: df.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0) if tags else df
    selectable = wanted(known).select("hyperedge_id")
    if tags:
        selectable = selectable.union(wanted(gone.hyperedges).select("id")).distinct()
    of_nodes = lambda ids, members: members.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").where("hyperedge_id IS NOT NULL").select("hyperedge_id")
    seeds = hit_strands.select(F.col("id").alias("hyperedge_id")).union(hit_members.select("hyperedge_id")).union(hit_edges.select(F.col("owner"))).union(gone.seeds).where("hyperedge_id IS NOT NULL")
    active = seeds.union(of_nodes(direct, graph.members)).distinct()
    active = [kept(active.join(selectable, "hyperedge_id", "left_semi") if tags else active, "active")]
    policy = graph.hyperedges.select(F.col("id").alias("hyperedge_id"), "include_roles", "exclude_roles", F.lit(True).alias("_known"))
    chosen = member_selected(F.col("role"), F.col("required"), F.col("include_roles"), F.col("exclude_roles"), include_optional)

    # members of active hyperedges that their policies select, and all members of other hyperedges and of those without a policy
    dealt = graph.members.select("hyperedge_id", "node_id", "role", "required").where("hyperedge_id IS NOT NULL")
    if tags:
        dealt = dealt.join(selectable, "hyperedge_id", "left_semi")
    dealt = dealt.join(active[0].withColumn("_active", F.lit(True)), "hyperedge_id", "left").join(policy, "hyperedge_id", "left")
    shown_at_once = F.col("_active").isNotNull() & F.col("_known").isNotNull()
    dealt = dealt.where(~shown_at_once | chosen).select("hyperedge_id", "node_id", "role", "required", F.col("_active").isNotNull().alias("active"), shown_at_once.alias("shown"))
    dealt = kept(dealt, "dealt")
    others = dealt.where("NOT active").drop("active", "shown")

    def expanded(rows: DataFrame, seen: list[DataFrame]) -> DataFrame:
        """Selected members that weren't seen, each with the least hyperedge that shows it."""
        rows = rows.groupBy(F.col("node_id").alias("id")).agg(F.min("hyperedge_id").alias("h"))
        for level in seen:
            rows = rows.join(level.select("id"), "id", "left_anti")
        return rows.select("id", F.concat(F.lit("member of strand "), "h").alias("reason"))

    levels = [direct]
    levels.append(kept(expanded(dealt.where("shown"), levels), "level"))
    if depth is None:
        row = graph.hyperedges.join(active[0].withColumnRenamed("hyperedge_id", "id"), "id", "left_semi").agg(F.max("depth")).collect()[0]
        depth = default_depth if row[0] is None else row[0]
    if depth > 0:
        asked = kinds or default_kinds
        follow = graph.edges.where(F.col("kind").isin(asked)) if asked else graph.edges
        if not kinds:
            own = graph.hyperedges.select(F.col("id").alias("owner"), F.col("follow_relations").alias("_follow"))
            free = F.col("_follow").isNull() | (F.size("_follow") == 0) | F.array_contains("_follow", F.col("kind"))
            follow = follow.join(own, "owner", "left").where(free)
        lost = gone.edges.where(F.col("kind").isin(asked)) if asked else gone.edges
        both = follow.select("src", "dst", "kind").union(lost)
        seen = direct.select("id").union(levels[1].select("id"))
        for end in ("src", "dst"):
            both = both.join(seen.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        step = lambda a, b, way: F.when(F.col(f"_{b}").isNull(), F.struct(F.col(a).alias("at"), F.col(b).alias("id"), "kind", F.lit(way).alias("way"), F.col(f"_{a}").isNotNull().alias("near")))
        both = both.where("_src IS NULL OR _dst IS NULL").select(F.inline_outer(F.array_compact(F.array(step("src", "dst", "from"), step("dst", "src", "to")))))
        steps = kept(both, "steps")  # to nodes that weren't seen; near are those from nodes that were
    why = F.concat("kind", F.lit(" relationship "), "way", F.lit(" "), "at")
    frontier = None
    for _ in range(depth):
        new = steps.where("near") if frontier is None else steps.join(frontier.select(F.col("id").alias("at")), "at")
        for level in levels[2:]:
            new = new.join(level.select("id"), "id", "left_anti")
        new = kept(new.groupBy("id").agg(F.min(why).alias("reason")), "level")
        if new.isEmpty():
            break
        levels.append(new)
        later = of_nodes(new, others).distinct()
        later = later.join(selectable, "hyperedge_id", "left_semi") if tags else later
        later = kept(later, "active")
        active.append(later)
        more = others.join(later, "hyperedge_id", "left_semi").join(policy, "hyperedge_id").where(chosen)
        more = kept(expanded(more, levels), "level")
        levels.append(more)
        frontier = new.select("id").union(more.select("id"))

    found = direct.select("id", "reason", F.lit(True).alias("direct"))
    for level in levels[1:]:
        found = found.union(level.select("id", "reason", F.lit(False)))
    reasons = out["reasons"] = found
    if {"strands", "members", "related"} & set(parts):
        strands = active[0].select("hyperedge_id", F.lit(True).alias("direct"))
        for later in active[1:]:
            strands = strands.union(later.select("hyperedge_id", F.lit(False)))
        declared = known.select("hyperedge_id").union(gone.hyperedges.select("id"))
        strands = strands.groupBy("hyperedge_id").agg(F.max("direct").alias("direct")).join(declared.distinct(), "hyperedge_id", "left_semi")
        out["strands"] = strands = settle(strands, "strands")
    if {"members", "related"} & set(parts):
        shown = dealt.where("NOT shown").drop("active", "shown").union(gone.members).join(strands.select("hyperedge_id"), "hyperedge_id", "left_semi")
        lost = gone.hyperedges.select(F.col("id").alias("hyperedge_id"), "include_roles", "exclude_roles").join(policy, "hyperedge_id", "left_anti")
        shown = shown.join(policy.drop("_known").unionByName(lost), "hyperedge_id", "left").where(chosen).select("hyperedge_id", "node_id", "role")
        shown = shown.union(dealt.where("shown").select("hyperedge_id", "node_id", "role"))
        shown = shown.join(reasons.withColumnRenamed("id", "node_id"), "node_id", "left")
        default = F.concat(F.lit("member of strand "), "hyperedge_id")
        members = shown.select("hyperedge_id", "node_id", "role", F.coalesce("reason", default).alias("reason"), F.coalesce("direct", F.lit(False)).alias("direct")).distinct()
        out["members"] = members = settle(members, "shown") if "related" in parts else members
    if "related" in parts:
        out["related"] = settle(reasons.join(members.select(F.col("node_id").alias("id")), "id", "left_anti"), "related")
    forget(spark, *[df for df in made if not any(df is read for read in (*levels, dealt))])  # the results read these
    return out
