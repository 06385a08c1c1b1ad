"""Coherence: entity grids, similarity of ordered vectors, topic sequences, and components of sentence graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialize

THRESHOLD = 0.6


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if one of them is all zeros."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_pairs(vectors: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Pairs i < j of each group's vectors: group, i, j, sim. Norms are taken once for each vector.

    All pairs of a group are its definition; a group is one document's sentences.
    """
    from pyspark.sql import Window as W

    numbered = vectors.select(F.col(group).alias("doc"), (F.row_number().over(W.partitionBy(group).orderBy(order)) - 1).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    unit = numbered.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    a = unit.select("doc", "i", F.col("v").alias("va"), F.col("norm").alias("na"))
    b = unit.select("doc", F.col("i").alias("j"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "doc").filter("i < j").select("doc", "i", "j", F.try_divide(dot, F.col("na") * F.col("nb")).alias("sim"))


def neighbours(vectors: DataFrame, group: str, order: str, vector: str, topic: str) -> DataFrame:
    """doc, i, topic, next_topic, sim: every vector with the one after it in its group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(order)
    rows = vectors.select(F.col(group).alias("doc"), (F.row_number().over(w) - 1).alias("i"), F.col(topic).alias("topic"), F.lead(topic).over(w).alias("next_topic"), F.col(vector).alias("v"), F.lead(vector).over(w).alias("after"))
    return rows.filter("after is not null").select("doc", "i", "topic", "next_topic", cosine(F.col("v"), F.col("after")).alias("sim"))


def entity_edges(entities: DataFrame) -> DataFrame:
    """Sentence pairs i < j of a document that share an entity, found through the entity, not by all pairs."""
    s = entities.select("doc_id", "sent_idx", "entity").distinct()
    a, b = s.withColumnRenamed("sent_idx", "i"), s.withColumnRenamed("sent_idx", "j")
    return a.join(b, ["doc_id", "entity"]).filter("i < j").select("doc_id", "i", "j").distinct()


def components(nodes: DataFrame, edges: DataFrame, group: str = "doc_id", rounds: int = 40) -> DataFrame:
    """group, node, component (its smallest node): smallest labels spread along edges, with pointer jumping.

    ``nodes(group, node)``, ``edges(group, i, j)``. Every round is cut through a table, so lineage
    stays short and a lost executor costs one round.
    """
    both = edges.select(group, "i", "j").unionByName(edges.select(group, F.col("j").alias("i"), F.col("i").alias("j")))
    both = materialize(both)
    labels = materialize(nodes.select(group, "node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(group, F.col("node").alias("j"), F.col("component").alias("other")), [group, "j"]).groupBy(group, F.col("i").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, [group, "node"], "left").select(group, "node", F.least("component", F.coalesce("other", "component")).alias("new"), F.col("component").alias("old"))
        jump = step.select(group, F.col("node").alias("new"), F.col("new").alias("far"))
        moved = materialize(step.join(jump, [group, "new"], "left").select(group, "node", F.least(F.col("new"), F.coalesce("far", "new")).alias("component"), "old"))
        labels = moved.drop("old")
        if not moved.filter("component <> old").limit(1).count():
            break
    return labels
