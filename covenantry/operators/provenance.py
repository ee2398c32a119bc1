"""Whether a graph holds together: ids, ends of edges, evidence of facts and its boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ratio

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def _bad_box(box: Column) -> Column:
    return F.coalesce((box["x0"] > box["x1"]) | (box["y0"] > box["y1"]), F.lit(False))


def _empty(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) == ""


def _lost_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id that edges name and no node has. The ends are made distinct before they are joined, so a hub is one row."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id").distinct(), ends["node_id"].eqNullSafe(nodes["node_id"]), "left_anti")


def findings(nodes: DataFrame, edges: DataFrame, facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """subject (node, edge or fact), id, finding, is_error: a row for everything that is wrong.

    nodes: node_id, box; edges: edge_id, source, target; facts: fact_id, document_id, block_id (both null: no evidence), box; blocks: document_id, block_id, the blocks that there are.
    Errors: empty_id, malformed_box, orphan_source, orphan_target, no_evidence. Warnings: self_loop, unknown_block (evidence that names a block that is not there)."""

    def some(df: DataFrame, subject: str, id_: str, *rules: tuple[str, bool, Column]) -> DataFrame:
        made = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(name).alias("finding"), F.lit(error).alias("is_error"))) for name, error, rule in rules)))
        return df.select(F.lit(subject).alias("subject"), F.col(id_).alias("id"), F.inline(made))

    lost = _lost_ends(nodes, edges)
    end = lambda side: edges.alias("e").join(lost.alias("lost"), F.col(f"e.{side}").eqNullSafe(F.col("lost.node_id")), "left_semi")
    known = blocks.select("document_id", "block_id").distinct().withColumn("is_known", F.lit(True))
    placed = facts.join(known, ["document_id", "block_id"], "left")
    none = F.col("document_id").isNull() & F.col("block_id").isNull()
    return (
        some(nodes, "node", "node_id", ("empty_id", True, _empty("node_id")), ("malformed_box", True, _bad_box(F.col("box"))))
        .unionByName(some(edges, "edge", "edge_id", ("self_loop", False, F.coalesce(F.col("source") == F.col("target"), F.lit(False)))))
        .unionByName(some(end("source"), "edge", "edge_id", ("orphan_source", True, F.lit(True))))
        .unionByName(some(end("target"), "edge", "edge_id", ("orphan_target", True, F.lit(True))))
        .unionByName(some(placed, "fact", "fact_id", ("no_evidence", True, none), ("malformed_box", True, ~none & _bad_box(F.col("box"))), ("unknown_block", False, ~none & F.col("is_known").isNull())))
    )


def report(nodes: DataFrame, edges: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals, facts_with_provenance, provenance_coverage (1 of no facts), orphan_edges (each end counts), orphan_edge_rate (0 of no edges), invalid_boxes, self_loops, empty_ids, unknown_blocks, is_valid."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    of = lambda *names: F.count_if(F.col("finding").isin(*names))
    wrong = found.agg(
        of("no_evidence").alias("without"), of("orphan_source", "orphan_target").alias("orphan_edges"), of("malformed_box").alias("invalid_boxes"), of("self_loop").alias("self_loops"),
        of("empty_id").alias("empty_ids"), of("unknown_block").alias("unknown_blocks"), F.count_if("is_error").alias("errors"),
    )
    one = n(nodes, "total_nodes").join(n(edges, "total_edges")).join(n(facts, "total_facts")).join(wrong)  # a row each
    sourced = F.col("total_facts") - F.col("without")
    return one.select(
        "total_nodes", "total_edges", "total_facts", sourced.alias("facts_with_provenance"), ratio(sourced, F.col("total_facts"), 1.0).alias("provenance_coverage"), "orphan_edges",
        ratio(F.col("orphan_edges"), F.col("total_edges"), 0.0).alias("orphan_edge_rate"), "invalid_boxes", "self_loops", "empty_ids", "unknown_blocks", (F.col("errors") == 0).alias("is_valid"),
    )
