"""Connected components of a link table, by contraction.

In each round every class takes the smallest class it is linked to, chains of
such steps are followed to their end, and the links are rewritten to classes;
rounds end when no link joins two classes. Each round at least halves the
number of classes that have links. Nothing is collected; what a round has found
is stored in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of `links` (a, b); class is its smallest node."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a != b").distinct(), "links")
    classes = stored(edges.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct(), "classes")
    while not edges.isEmpty():
        steps = edges.groupBy("a").agg(F.min("b").alias("b"))
        steps = stored(steps.select("a", F.least("a", "b").alias("to")), "steps")
        while True:
            onward = steps.select(F.col("a").alias("to"), F.col("to").alias("then"))
            jumped = stored(
                steps.join(onward.hint("merge"), "to").select("a", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")),
                "steps",
            )
            steps = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        renamed = steps.select(F.col("a").alias("class"), F.col("to").alias("final"))
        classes = stored(
            classes.join(renamed.hint("merge"), "class", "left").select("node", F.coalesce("final", "class").alias("class")), "classes"
        )
        first = steps.select("a", F.col("to").alias("first"))
        second = steps.select(F.col("a").alias("b"), F.col("to").alias("second"))
        edges = stored(
            edges.join(first.hint("merge"), "a")
            .join(second.hint("merge"), "b")
            .where("first != second")
            .select(F.col("first").alias("a"), F.col("second").alias("b"))
            .distinct(),
            "links",
        )
    return classes
