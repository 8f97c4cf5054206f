"""A graph assembled from fragments: declarations in sidecar files and in annotations, by precedence, with implied rows made real.

Fragments are ordered by the canonical sequence: sidecars first, then by file, line and place.  Every first-wins rule is an aggregate
over that order (``min_by``), which combines before the shuffle, so an id that a third of all fragments declare costs one row
from each task.  ``refresh`` assembles only the keys that changed fragments declare or refer to, before and after.

nodes        (id, version, target, kind, location, tags, attributes, source, file, line, ord[, row])
hyperedges   (id, version, intent, tags, attributes, source, file, line, ord)
members      (hyperedge_id, node_id, role, required, attributes, source, file, line, ord)
edges        (owner, src, dst, kind, attributes, source, file, line, ord)

``location`` is a struct of path, line_start, line_end and watch; ``attributes`` is a map of text; ``row`` is where a row stands in its
table, which tells apart declarations of one id that stand at one place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as N
from ..sources.settled import settle

LOCATION = "struct<path:string,line_start:int,line_end:int,watch:string>"
_WHERE = ["source", "file", "line"]
PARTS = ("nodes", "hyperedges", "members", "edges")
#: What members and edges are told apart by.
MEMBER_KEY, EDGE_KEY = ["hyperedge_id", "node_id", "role"], ["owner", "src", "dst", "kind"]


@dataclass(frozen=True)
class Fragments:
    nodes: DataFrame
    hyperedges: DataFrame
    members: DataFrame
    edges: DataFrame

    def each(self, use) -> Fragments:
        return Fragments(use(self.nodes), use(self.hyperedges), use(self.members), use(self.edges))


@dataclass(frozen=True)
class Assembled:
    nodes: DataFrame
    hyperedges: DataFrame
    members: DataFrame
    edges: DataFrame


def place(*more: Column | str) -> Column:
    """The canonical sequence; a missing line comes before others, and what ``more`` names settles ties, nulls last."""
    plain = [F.col(c) if isinstance(c, str) else c for c in more]
    ties = [c for i, x in enumerate(plain) for c in (x.isNull().alias(f"n{i}"), x.cast("string").alias(f"m{i}"))]
    return F.struct((F.col("source") != "sidecar").alias("later"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(-1)).alias("line"), F.col("ord").alias("ord"), *ties)


def node_place(nodes: DataFrame, last: bool = False) -> Column:
    """The place of declared nodes; of equal ones the first row comes first, with ``last`` it comes last (for the latest of all)."""
    row = F.col("row") if "row" in nodes.columns else F.lit(0).cast("long")
    return F.struct(place("target").alias("at"), (-row if last else row).alias("row"))


def _file_location(target: Column) -> Column:
    t = N.file_target(target)
    made = F.struct(t["path"].alias("path"), t["line_start"].cast("int").alias("line_start"), t["line_end"].cast("int").alias("line_end"), t["watch"].alias("watch"))
    return F.when(t["path"].isNotNull(), made).cast(LOCATION)


def _normal(location: Column) -> Column:
    own = F.struct(N.normalize_path(location["path"]).alias("path"), location["line_start"].alias("line_start"), location["line_end"].alias("line_end"), location["watch"].alias("watch"))
    return F.when(location.isNotNull(), own).cast(LOCATION)


def looks_like_target(x: Column) -> Column:
    return F.contains(x, F.lit("://")) | F.contains(x, F.lit("#L")) | F.contains(x, F.lit("/"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: ``side`` and ``note``, the first declaration of either kind, and what later annotations add."""
    rows = nodes.withColumn("location", _normal(F.col("location"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    at, latest, note = node_place(nodes), node_place(nodes, True), F.col("source") != "sidecar"
    whole = F.struct("version", "target", "kind", "location", "tags", "attributes", *_WHERE)
    only = lambda take, x, when: take(F.when(when, x), F.when(when, latest if take is F.max_by else at))
    aggregates = {
        "side": only(F.min_by, whole, ~note), "note": only(F.min_by, whole, note), "note_location": only(F.max_by, F.col("location"), note & F.col("location").isNotNull()),
        "note_target": only(F.min_by, F.col("target"), note & F.col("target").isNotNull()), "note_kind": only(F.min_by, F.col("kind"), note & F.col("kind").isNotNull()),
        "note_tags": F.flatten(F.collect_set(F.when(note, F.col("tags")))),
    }
    return rows.groupBy("id").agg(*[v.alias(k) for k, v in aggregates.items()])


def assembled_nodes(first: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes, then those that references to targets imply.

    A sidecar's node takes the last location of its annotations, and the first target and kind where it has none; the tags
    of all; attributes stay the sidecar's.  A file target gives a location where there is none.
    """
    has = F.col("side").isNotNull()
    pick = lambda own, other: F.when(has, F.coalesce(own, other))
    tags = F.array_sort(F.array_distinct(F.when(has, F.concat("side.tags", "note_tags")).otherwise(F.col("note.tags"))))
    location = pick(F.col("note_location"), F.col("side.location"))
    of = lambda c: F.when(has, F.col(f"side.{c}")).otherwise(F.col(f"note.{c}"))
    rows = first.select("id", F.when(has, F.coalesce("side.target", "note_target")).otherwise(F.col("note.target")).alias("target"), F.when(has, F.coalesce("side.kind", "note_kind")).otherwise(F.col("note.kind")).alias("kind"),
        F.when(has, location).otherwise(F.col("note.location")).alias("location"), tags.alias("tags"), of("attributes").alias("attributes"), *[of(c).alias(c) for c in _WHERE])
    rows = rows.withColumn("location", F.coalesce("location", _file_location(F.col("target"))))
    refer = members.select(F.col("node_id").alias("id"), F.lit(0).alias("turn"), place("role").alias("at"), *_WHERE)
    for end in ("src", "dst"):
        refer = refer.unionByName(edges.select(F.col(end).alias("id"), F.lit(1).alias("turn"), place("kind").alias("at"), *_WHERE))
    implied = refer.where(looks_like_target(F.col("id"))).groupBy("id").agg(F.min_by(F.struct(*_WHERE), F.struct("turn", "at")).alias("w"))
    implied = implied.join(first.select("id"), "id", "left_anti")
    made = implied.select("id", F.col("id").alias("target"), F.lit(None).cast("string").alias("kind"), _file_location(F.col("id")).alias("location"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast(first.schema["side"].dataType["attributes"].dataType).alias("attributes"), *[F.col(f"w.{c}").alias(c) for c in _WHERE])
    return rows.unionByName(made)


def first_hyperedges(hyperedges: DataFrame, members: DataFrame) -> DataFrame:
    """The first declaration of each hyperedge; those that only members name are made, with ``implied`` true."""
    whole = F.struct("version", "intent", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "attributes", *_WHERE)
    first = hyperedges.groupBy("id").agg(F.min_by(whole, place("intent")).alias("x")).select("id", "x.*", F.lit(False).alias("implied"))
    named = members.where("hyperedge_id IS NOT NULL").groupBy(F.col("hyperedge_id").alias("id")).agg(F.min_by(F.struct(*_WHERE), place("node_id", "role")).alias("w")).join(first.select("id"), "id", "left_anti")
    made = named.select("id", F.lit(1).alias("version"), F.lit("").alias("intent"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast(first.schema["attributes"].dataType).alias("attributes"), *[F.col(f"w.{c}").alias(c) for c in _WHERE], F.lit(True).alias("implied"))
    return first.unionByName(made)


def distinct_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in the canonical sequence; null is a value like others."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), place(*[c for c in ("required", "attributes") if c in rest and c != "attributes"])).alias("x"))
    return kept.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def assembled(fragments: Fragments) -> Assembled:
    """The graph of all fragments."""
    first = first_nodes(fragments.nodes)
    nodes = assembled_nodes(first, fragments.members, fragments.edges)
    hyperedges = first_hyperedges(fragments.hyperedges, fragments.members)
    return Assembled(nodes, hyperedges, distinct_first(fragments.members, MEMBER_KEY), distinct_first(fragments.edges, EDGE_KEY))


def sequenced(rows: DataFrame, *ties: str) -> DataFrame:
    """Adds ``seq``, ascending in the canonical sequence over all rows; a range-partitioned sort, settled as numbers depend on it."""
    return settle(rows.repartitionByRange(place(*ties)).sortWithinPartitions(place(*ties)).withColumn("seq", F.monotonically_increasing_id()), "sequenced")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which null equals null, as an equi-join on the values and on whether they are there."""
    own = lambda df: [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    names = [f"_{x}{i}" for x in "kn" for i in range(len(keys))]
    return a.select("*", *own(a)).join(b.select(*own(b)).distinct(), names, how).drop(*names)


def refresh(table: Assembled, old: Fragments, new: Fragments, changed: DataFrame, parts: tuple[str, ...] = PARTS) -> Assembled:
    """The graph after the files in ``changed`` (file) went from their old fragments to their new ones; equal to assembling anew.

    Rows of keys that no changed fragment touches are kept as they are.  Only the ``parts`` that are asked for are made, from the
    fragments that they depend on; of others the table's rows stay.
    """
    files = changed.select("file").distinct()
    within = lambda df: df.join(files, "file", "left_semi")
    keep = lambda df, ids: df.join(ids, "id", "left_anti")
    by = lambda df, column, ids: df.join(ids.select(F.col("id").alias(column)), column, "left_semi")

    def touched(*of: tuple[str, list[str], str]) -> DataFrame:
        """(id): what changed fragments (table, columns, condition) declare or refer to, before and after."""
        every = None
        for name, columns, where in of:
            for side in (old, new):
                rows = within(getattr(side, name).select("file", *columns)).select(F.explode(F.array(*columns)).alias("id")).where(where).distinct()
                every = rows if every is None else every.union(rows)
        return settle(every.distinct(), "touched")

    def keyed(name: str, keys: list[str]) -> DataFrame:
        rows = [within(getattr(side, name).select("file", *keys)).select(*keys) for side in (old, new)]
        hit = settle(rows[0].union(rows[1]).distinct(), "touched")
        fresh = distinct_first(_null_safe(getattr(new, name), hit, keys, "left_semi"), keys)
        return _null_safe(getattr(table, name), hit, keys, "left_anti").unionByName(fresh)

    made = {}
    if "nodes" in parts:
        ids = touched(("nodes", ["id"], "true"), ("members", ["node_id"], "true"), ("edges", ["src", "dst"], "true"))
        first = first_nodes(by(new.nodes, "id", ids))
        target = lambda c: looks_like_target(F.col(c))
        refer = new.edges.where(target("src") | target("dst"))  # only these imply a node
        nodes = by(assembled_nodes(first, by(new.members.where(target("node_id")), "node_id", ids), refer), "id", ids)
        made["nodes"] = keep(table.nodes, ids).unionByName(nodes)
    if "hyperedges" in parts:
        ids = touched(("hyperedges", ["id"], "true"), ("members", ["hyperedge_id"], "id IS NOT NULL"))
        made["hyperedges"] = keep(table.hyperedges, ids).unionByName(first_hyperedges(by(new.hyperedges, "id", ids), by(new.members, "hyperedge_id", ids)))
    for name, keys in (("members", MEMBER_KEY), ("edges", EDGE_KEY)):
        if name in parts:
            made[name] = keyed(name, keys)
    return replace(table, **made)


def _rules(rows: DataFrame, subject: Column, *rules: tuple[Column, str, str]) -> DataFrame:
    """(severity, code, subject, path, line): one scan for all row rules (condition, severity, code)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for when, severity, code in rules]))
    return rows.select(subject.alias("subject"), F.col("file").alias("path"), "line", F.inline(found)).select("severity", "code", "subject", "path", "line")


def _forbidden(*names: str) -> list[tuple[Column, str, str]]:
    return [(F.map_contains_key(F.coalesce("attributes", F.create_map().cast("map<string,string>")), name), "error", "removed-metadata-field") for name in names]


def diagnostics(fragments: Fragments) -> DataFrame:
    """(severity, code, subject, path, line) of all integrity rules: row rules in one scan of each table, rules of ids in one join
    with the first declarations, and references in one anti-join with the assembled graph."""
    first = first_nodes(fragments.nodes)
    nodes = fragments.nodes.withColumn("location", _normal(F.col("location")))
    side = F.col("source") == "sidecar"
    blank = lambda c: (F.btrim(c) == "") | F.col(c).rlike(r"\s")
    path, start, end = F.col("location.path"), F.col("location.line_start"), F.col("location.line_end")
    outside = (F.btrim(path) == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    out = [
        _rules(nodes.where(side), F.col("id"), (F.col("version") != 1, "error", "anchor-schema"), (blank("id"), "error", "anchor-id"), *_forbidden("description"), (F.col("target").isNull() & F.col("location").isNull(), "warning", "anchor-unlocated"),
            (F.col("location.watch") == "node", "error", "anchor-node-location"), (outside, "error", "anchor-path"), ((start == 0) | (end == 0) | (end < start), "error", "anchor-range")),
        _rules(fragments.hyperedges.where(side), F.col("id"), (F.col("version") != 1, "error", "strand-schema"), (blank("id"), "error", "strand-id"), (F.btrim("intent") == "", "warning", "strand-intent")),
        _rules(fragments.members, F.col("node_id"), *_forbidden("rationale", "reason")),
        _rules(fragments.edges, F.col("kind"), *_forbidden("rationale", "reason"), (F.btrim("kind") == "", "error", "relation-kind")),
    ]
    # ids: a second sidecar, or an annotation that differs from the first one where there is no sidecar
    at = node_place(nodes)
    firsts = nodes.groupBy("id").agg(F.min(F.when(side, at)).alias("side_at"), F.min(F.when(~side, at)).alias("note_at"))
    firsts = firsts.join(first.select("id", "side", "note", F.coalesce("side.target", "note_target").alias("known")), "id")
    rows = nodes.withColumn("at", at).join(firsts, "id")
    same = F.col("location").eqNullSafe(F.col("note.location")) & F.col("target").eqNullSafe(F.col("note.target"))
    again = (side & (F.col("at") > F.col("side_at"))) | (~side & F.col("side").isNull() & (F.col("at") > F.col("note_at")) & ~same)
    conflict = ~side & F.col("side").isNotNull() & F.col("known").isNotNull() & F.col("target").isNotNull() & (F.col("known") != F.col("target"))
    out.append(_rules(rows, F.col("id"), (again, "error", "duplicate-anchor"), (conflict, "error", "anchor-target-conflict")))
    at = place("intent")
    firsts = fragments.hyperedges.groupBy("id").agg(F.min(F.when(side, at)).alias("side_at"), F.min(F.when(~side, at)).alias("note_at"))
    rows = fragments.hyperedges.withColumn("at", at).join(firsts, "id")
    again = (side & (F.col("at") > F.col("side_at"))) | (~side & F.col("side_at").isNull() & (F.col("at") > F.col("note_at")))
    out.append(_rules(rows, F.col("id"), (again, "error", "duplicate-strand")))
    implied = first_hyperedges(fragments.hyperedges, fragments.members).where("implied")
    out.append(_rules(implied, F.col("id"), (F.lit(True), "warning", "implicit-strand")))
    refer = fragments.members.select(F.col("node_id").alias("subject"), F.lit("unresolved-anchor").alias("code"), "file", "line")
    for name in ("src", "dst"):
        refer = refer.unionByName(fragments.edges.select(F.col(name).alias("subject"), F.lit("unresolved-relation-anchor").alias("code"), "file", "line"))
    # a reference that looks like a target has been made a node
    unknown = refer.where(~looks_like_target(F.col("subject"))).join(first.select(F.col("id").alias("subject")), "subject", "left_anti")
    out.append(unknown.select(F.lit("error").alias("severity"), "code", "subject", F.col("file").alias("path"), "line"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def restricted(fragments: Fragments, files: DataFrame) -> Fragments:
    """The fragments of some files (file)."""
    return replace(fragments.each(lambda df: df.join(files.select("file").distinct(), "file", "left_semi")))
