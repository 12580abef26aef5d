"""Graph fold in two strata: nodes first, then edges with the node changes that reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.fold import _no_info, ordered_fold


def node_changes(folded_nodes: DataFrame) -> DataFrame:
    """Deletes and (re)creations from the node outcomes, by node id."""
    return folded_nodes.where("row_type = 'outcome' and outcome in ('deleted', 'created') and facet = ''").select(
        "adapter_id", F.col("entity_key").alias("node"), F.col("target").alias("label"), "batch_id", "seq", "position", "line_no", "event_id", "permanent", (F.col("outcome") == "deleted").alias("dead"),
    )


def edge_changes(edge_writes: DataFrame, changes: DataFrame) -> DataFrame:
    """FOLD_IN rows that tell every edge of the changes at its ends; a self-loop hears each once.

    A join on node id, of the distinct (edge, end) pairs: adaptive execution splits hub nodes.
    """
    ends = edge_writes.select("adapter_id", "target", "entity_key", "ends").where("ends is not null").distinct()
    ends = ends.withColumn("node", F.explode(F.array_distinct(F.from_json("ends", "array<string>"))))
    null = F.lit(None).cast("string")
    return ends.join(changes, ["adapter_id", "node"]).select(
        "adapter_id", F.lit("edge").alias("kind"), "target", "entity_key", F.lit(1).alias("rank"), "batch_id", "seq", "position", "line_no", "event_id", null.alias("facet"), F.lit("node").alias("operation"),
        F.when(F.col("dead"), "dead").otherwise("alive").alias("mode"), "permanent", null.alias("body"), "ends", F.concat_ws("\x1f", "label", "node").alias("aux"), *_no_info(),
    )


def tombstones(node_state: DataFrame) -> DataFrame:
    """Nodes of an earlier state that are deleted, as changes before every event."""
    dead = node_state.where("kind = 'node' and not live and lanes is not null")
    lane = F.from_json("lanes", "map<string,array<string>>")[""]
    return dead.select(
        "adapter_id", F.col("entity_key").alias("node"), F.col("target").alias("label"), F.lit(-1).cast("long").alias("batch_id"), lane[0].cast("long").alias("seq"), F.lit("").alias("position"),
        F.lit(0).cast("long").alias("line_no"), lane[1].alias("event_id"), lane[3].cast("boolean").alias("permanent"), F.lit(True).alias("dead"),
    )


def fold_graph(node_rows: DataFrame, edge_rows: DataFrame, earlier: DataFrame | None = None, instants: bool = False) -> tuple[DataFrame, DataFrame]:
    """Folded nodes and folded edges. Both inputs are FOLD_IN rows, seeds of earlier state included.

    ``earlier``: state rows from before; edges then also hear of nodes deleted in earlier batches. ``instants``: see ``ordered_fold``.
    """
    nodes = ordered_fold(node_rows)
    changes = node_changes(nodes)
    if earlier is not None:
        changes = changes.unionByName(tombstones(earlier))
    return nodes, ordered_fold(edge_rows.unionByName(edge_changes(edge_rows, changes)), instants)


def incident(edge_state: DataFrame) -> DataFrame:
    """Live edges by end: the incident index, derived."""
    ends = F.from_json("ends", "array<string>")
    return edge_state.where("live").select("adapter_id", F.explode(F.array_distinct(ends)).alias("node"), F.col("target").alias("edge_type"), "entity_key", ends[0].alias("from_id"), ends[1].alias("to_id"))
