"""Context packets: source filters, change sets, seeds and their ranks, requests for source, excerpts and summaries.

Filters and seeds are column expressions over a bounded list of arguments, so they cost no shuffle; first-wins rules are
aggregations, which combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as N
from .intervals import merged

#: The last line of a request for a whole file.
LAST_LINE = 2**31 - 1


def _extensions(values: list[str]) -> list[str]:
    found = [v.strip().lstrip(".").lower() for v in values]
    if any(not v or "/" in v or "\\" in v for v in found):
        raise ValueError(f"not an extension: {values}")
    return found


def source_allowed(path: Column, language: Column, includes: list[str] = (), excludes: list[str] = (), extensions: list[str] = (), excluded_extensions: list[str] = (), languages: list[str] = (), excluded_languages: list[str] = ()) -> Column:
    """Whether all filters let a source through.  A missing extension or language fails an allow-list and passes a deny-list."""
    if any(not g.strip() for g in (*includes, *excludes)):
        raise ValueError("an empty glob")
    named = lambda values: [N.language(F.lit(v)) for v in values]
    ext, lang, out = N.extension(path), N.language(language), F.lit(True)
    if includes:
        out = out & N.matches_any(path, list(includes))
    if excludes:
        out = out & ~N.matches_any(path, list(excludes))
    for value, allow, deny in ((ext, [F.lit(v) for v in _extensions(extensions)], [F.lit(v) for v in _extensions(excluded_extensions)]), (lang, named(languages), named(excluded_languages))):
        if allow:
            out = out & F.coalesce(value.isin(*allow), F.lit(False))
        if deny:
            out = out & ~F.coalesce(value.isin(*deny), F.lit(False))
    return out


def change_set(explicit: DataFrame, diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, old_path, status, whole_file, ranges) of each changed path.

    A named file (path) counts as a whole; if it is in the diff as well, it takes the diff's status, former path and ranges
    and stays whole.  A file of the diff (ord, path, old_path, status, ranges) has the ranges of all its entries and the status
    of the last one; it is whole if it has no ranges.  An untracked file (path) adds nothing to one that is named or differs.
    """
    span = diff.schema["ranges"].dataType
    none = F.lit(None).cast("struct<old_path:string,status:string,ord:bigint>")
    kind = lambda df, name: df.select("path", F.lit(name).alias("kind"), none.alias("x"), F.array().cast(span).alias("ranges"))
    entry = F.struct("old_path", "status", F.col("ord").cast("long").alias("ord"))
    rows = kind(explicit, "named").union(kind(untracked, "untracked")).union(diff.select("path", F.lit("diff"), entry, F.coalesce("ranges", F.array().cast(span))))
    last = F.max_by("x", F.when(F.col("kind") == "diff", F.col("x.ord")))
    out = rows.groupBy("path").agg(F.max(F.col("kind") == "named").alias("named"), last.alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"))
    status = F.coalesce("x.status", F.when(F.col("named"), "modified").otherwise("untracked"))
    return out.select("path", F.col("x.old_path").alias("old_path"), status.alias("status"), (F.col("named") | (F.size("ranges") == 0)).alias("whole_file"), "ranges")


def focused(nodes: DataFrame, ids: list[str] = (), symbols: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """(id, ord) of the nodes (id, symbol, path) that arguments name exactly; ord is the place of the first such argument."""
    given = [*(("id", v) for v in ids), *(("symbol", v) for v in symbols), *(("path", v) for v in paths)]
    places = [F.when(F.col(c) == (N.normalize_path(F.lit(v)) if c == "path" else F.lit(v)), F.lit(i)) for i, (c, v) in enumerate(given)]
    return nodes.select("id", F.coalesce(*places, F.lit(None).cast("int")).alias("ord")).where("ord IS NOT NULL")


def seed_reasons(nodes: DataFrame, symbols: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """(id, reason) of the nodes (id, symbol, path) with a symbol, or in a path or a folder, of the arguments.

    The reasons stand in the arguments' order, joined by "; "; one that the text so far contains isn't repeated.
    """
    found = [F.when(F.col("symbol") == v, F.lit(f'symbol "{v}" matched')) for v in symbols]
    for v in paths:
        path = N.normalize_path(F.lit(v))
        inside = (F.col("path") == path) | F.col("path").startswith(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/")))
        found.append(F.when(inside, F.concat(F.lit('path "'), path, F.lit('" matched'))))
    joined = lambda done, x: F.when(done == "", x).when(F.contains(done, x), done).otherwise(F.concat(done, F.lit("; "), x))
    reason = F.aggregate(F.array_compact(F.array(*found)), F.lit(""), joined)
    return nodes.select("id", reason.alias("reason")).where("reason <> ''")


def followed(edges: DataFrame, policies: DataFrame, kinds: list[str] | None = None, respect_policy: bool = True) -> DataFrame:
    """The edges (kind, owner, ...) that may be followed: of the given kinds, and of those that the owner's policy follows.

    policies: (hyperedge_id, follow_relations), one row for each; an edge without an owner, an owner without a policy and an
    empty list set no bound.
    """
    rows = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    if not respect_policy:
        return rows
    own = policies.select(F.col("hyperedge_id").alias("owner"), F.col("follow_relations").alias("_follow"))
    free = F.col("_follow").isNull() | (F.size("_follow") == 0)
    return rows.join(own, "owner", "left").where(free | F.array_contains("_follow", F.col("kind"))).drop("_follow")


def changed_declarations(declared: DataFrame, changes: DataFrame) -> DataFrame:
    """The declarations (source, path, line, ...) that a change set touched: a sidecar by any change of its file, an annotation
    by its line; an annotation without a line, and anything else, by none."""
    by_path = changes.select(F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("path"), "whole_file", "ranges")
    on_line = F.col("whole_file") | F.exists("ranges", lambda r: F.col("line").between(r["start"], r["end"]))
    hit = (F.col("source") == "sidecar") | ((F.col("source") == "annotation") & F.col("line").isNotNull() & on_line)
    return declared.join(by_path, "path").where(hit).select(*declared.columns).distinct()


def with_values(members: DataFrame, current: DataFrame, removed: DataFrame) -> DataFrame:
    """Members (node_id, ...) with the value of their node: the current one, else that of a removed node, else null.

    current, removed: (id, value), one row for each id.
    """
    of = lambda df, name: df.select(F.col("id").alias("node_id"), F.struct("value").alias(name))
    rows = members.join(of(current, "_now"), "node_id", "left").join(of(removed, "_then"), "node_id", "left")
    x = F.coalesce("_now", "_then")
    rows = rows.withColumns({"value": x["value"], "deleted": F.col("_now").isNull() & F.col("_then").isNotNull()})
    return rows.drop("_now", "_then")


def requests(members: DataFrame, related: DataFrame, nodes: DataFrame, focus: DataFrame, source: str = "all", context_lines: int = 0) -> DataFrame:
    """(path, start, end, priority, ord, node_id, reference): the source that a packet asks for.

    Focused nodes come first (priority 0), then direct ones, those of direct hyperedges, and others.  ``source`` says which are
    asked for: none, focused, direct (nodes or hyperedges) or all.  Nodes without a path aren't.

    members: (hyperedge_id, hyperedge_direct, node_id, role, direct); related: (node_id, direct); nodes: (id, path, line_start,
    line_end, watch); focus: (id, ord).
    """
    of_edge = F.concat_ws(":", F.concat_ws("/", "hyperedge_id", F.coalesce("role", F.lit("member"))), "node_id")
    rows = members.select("node_id", "direct", F.col("hyperedge_direct").alias("via"), of_edge.alias("reference"))
    rows = rows.union(related.select("node_id", "direct", F.lit(False), F.concat(F.lit("related:"), "node_id")))
    rows = rows.join(nodes.withColumnRenamed("id", "node_id").where("path IS NOT NULL"), "node_id").join(focus.withColumnRenamed("id", "node_id"), "node_id", "left")
    priority = F.when(F.col("ord").isNotNull(), 0).when(F.col("direct"), 1).when(F.col("via"), 2).otherwise(3)
    asked = {"none": F.lit(False), "focused": F.col("ord").isNotNull(), "direct": F.col("direct") | F.col("via"), "all": F.lit(True)}[source]
    file = F.coalesce(F.col("watch") == "file", F.lit(False))
    start = F.when(file, 1).otherwise(F.greatest(F.coalesce("line_start", F.lit(1)) - context_lines, F.lit(1)))
    last = F.coalesce("line_end", "line_start")
    end = F.when(file | last.isNull(), LAST_LINE).otherwise(F.least(last.cast("long") + context_lines, F.lit(LAST_LINE)))
    rows = rows.where(asked).select("path", start.cast("long").alias("start"), end.cast("long").alias("end"), priority.alias("priority"), F.coalesce("ord", F.lit(LAST_LINE)).alias("ord"), "node_id", "reference")
    return rows


def excerpts(ranges: DataFrame, files: DataFrame, gap: int = 0) -> DataFrame:
    """(path, line_start, line_end, n_ranges, text): each file's asked lines, once.

    ranges: (path, start, end), which are cut at the file's end and merged if at most ``gap`` lines lie between them; files:
    (path, lines).  Ranges that begin behind the end are left out.  Only ranges and line counts are merged; the texts join after it.
    """
    cut = ranges.join(files.select("path", F.size("lines").cast("long").alias("_n")), "path").where(F.col("start") <= F.col("_n"))
    cut = cut.select("path", F.col("start").alias("line_start"), F.least("end", "_n").alias("line_end"))
    whole = merged(cut, "path", "line_start", "line_end", gap)
    text = F.array_join(F.slice("lines", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    return whole.join(files, "path").select("path", "line_start", "line_end", "n_ranges", text.alias("text"))


def hidden_members(members: DataFrame, shown: int) -> DataFrame:
    """(hyperedge_id, nodes, files): how many members stand behind the first ``shown`` by id and role (none first), in how many
    files.  members: (hyperedge_id, node_id, role, path), distinct."""
    order = Window.partitionBy("hyperedge_id").orderBy("node_id", F.col("role").asc_nulls_first())
    first = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shown)
    key = lambda df: df.select("hyperedge_id", "node_id", F.coalesce("role", F.lit("")).alias("_role"), F.col("role").isNull().alias("_none"))
    rows = members.withColumns({"_role": F.coalesce("role", F.lit("")), "_none": F.col("role").isNull()}).join(key(first), ["hyperedge_id", "node_id", "_role", "_none"], "left_anti")
    return rows.groupBy("hyperedge_id").agg(F.count("*").alias("nodes"), F.countDistinct("path").alias("files"))
