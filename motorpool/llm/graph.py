"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component`` (its smallest reachable vertex) of all vertices of the edges ``a``, ``b`` (long).

    In every round each vertex goes over to its smallest neighbour, if that is smaller, twice in a row; the edges are
    then drawn between what is left, until none is. Vertices always go to smaller ones of their component, and the
    smallest never moves, so it is where all of them end. Every round at least halves what is left of a component
    but for its smallest vertices; state is stored in the shared folder after each, so a lost executor costs one
    round. Minima are combined before they are shuffled, and a vertex with very many edges is one row a task there.
    """
    spark = edges.sparkSession
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = left.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    state = vertices.select("vertex", F.col("vertex").alias("component"))
    if left.isEmpty():
        return spark.createDataFrame([], "vertex long, component long")
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        once = written(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"), "hooks")
        twice = once.alias("x").join(once.alias("y"), F.col("x.to") == F.col("y.a"), "left")
        up = written(twice.select(F.col("x.a").alias("a"), F.coalesce("y.to", "x.to").alias("to")), "hooks")
        moved = written(
            state.join(up, F.col("component") == F.col("a"), "left").select("vertex", F.coalesce("to", "component").alias("component")),
            "components",
        )
        drawn = left
        for end in ("a", "b"):
            step = up.select(F.col("a").alias("__from"), "to")
            drawn = drawn.join(step, F.col(end) == F.col("__from"), "left").withColumn(end, F.coalesce("to", end)).drop("__from", "to")
        ordered = drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = written(ordered.where("a <> b").distinct(), "edges")
        discard(once, up, left, state)
        left, state = rest, moved
        if left.isEmpty():
            discard(left)
            return state
