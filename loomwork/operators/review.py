"""Reviews of a change: required nodes, snapshots of files, dispositions, completion and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import drifted, missing_dispositions


def start(review_id: str, shown: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Tables of a new review: its nodes (required where a hyperedge requires them) and the hashes of their files.

    shown: (node_id, required, path); files: (path, hash).
    """
    nodes = shown.groupBy("node_id").agg(F.max(F.coalesce("required", F.lit(True))).alias("required")).select(F.lit(review_id).alias("review_id"), "node_id", "required")
    held = files.join(shown.select("path").distinct(), "path", "left_semi").select(F.lit(review_id).alias("review_id"), "path", "hash")
    return {"nodes": nodes, "files": held}


def recorded(dispositions: DataFrame, rows: DataFrame, nodes: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Dispositions with new ones (review_id, node_id, disposition, note); a newer one replaces an older one.

    Raises ValueError for nodes that aren't of the review and for dispositions that aren't allowed.
    """
    if allowed and not rows.where(~F.col("disposition").isin(allowed)).isEmpty():
        raise ValueError(f"a disposition must be one of {', '.join(allowed)}")
    if not rows.join(nodes, ["review_id", "node_id"], "left_anti").isEmpty():
        raise ValueError("a node is not part of the review")
    return dispositions.join(rows, ["review_id", "node_id"], "left_anti").unionByName(rows)


def completion(nodes: DataFrame, files: DataFrame, dispositions: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """What stands against completing: required nodes without a disposition, and files that have changed since."""
    need = nodes.where("required")
    return {"missing": missing_dispositions(need, dispositions, ["review_id", "node_id"]), "drift": drifted(files, current)}


def complete(nodes: DataFrame, files: DataFrame, dispositions: DataFrame, current: DataFrame, allow_missing: bool = False, allow_drift: bool = False) -> None:
    """Raises ValueError unless nothing stands against it, or it is allowed."""
    against = completion(nodes, files, dispositions, current)
    for kind, allowed in (("missing", allow_missing), ("drift", allow_drift)):
        n = 0 if allowed else against[kind].count()
        if n:
            raise ValueError(f"the review can't be completed: {kind} ({n})")
