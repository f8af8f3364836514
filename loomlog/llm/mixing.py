"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected `target / source size` times. Within a
source the documents stand in order of size; the expected copies are summed
along that order, one random offset is added, and a document is emitted once
for each integer the sum crosses. Sampling along the sizes keeps the words
taken near the target: long and short documents are thinned evenly.

The running sum of a source is never computed in one task. A document's place
is the number of smaller documents (counts per size), plus that of earlier bins
of its size, plus its place in its bin; a bin holds about `BIN_ROWS` rows, so a
source or size with a third of all rows spreads over as many tasks as it needs.
Everything is DataFrame expressions.

Defined cases: a null or empty text has size 0; a source without words has
target 0 and gives nothing; null is a source of its own, after all others; a
null doc_id ranks before the others of its bin. Rows that repeat an id are
sampled each for itself. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import stored, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
#: Rows of one bin, about: the unit that one task ranks.
BIN_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    ceiling: float = CEILING,
) -> DataFrame:
    """One row per source (source, source_size, target) from rows (source, size).

    The whole `share * all words` is dealt by weight; what exceeds a source's
    ceiling goes to the others by weight until none is above. That end state is
    target = min(ceiling * size, level * weight), and the level is the largest
    of those that arise when the sources are filled in order of ceiling / weight.
    The windows below run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights) + 1)
    every = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0)
    )
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sources.withColumn("level", left / weights_left)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def random_offset(seed: int, source: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def sample_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    ceiling: float = CEILING, seed: int = 0, carry: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies.

    With `carry`, also `doc`, a struct of all columns of the row. `copies` is at
    most the ceiling rounded up. The same seed and rows give the same copies.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        word_count(text_of()).alias("size"),
        F.xxhash64(text_of()).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
    )
    if not carry:
        rows = stored(rows, "mix-sizes")
    sizes = rows.groupBy("key", "source", "size").count()
    by_size = Window.partitionBy("key").orderBy("size")
    sizes = stored(
        sizes.withColumn("smaller", F.sum("count").over(by_size) - F.col("count")), "mix-by-size"
    )
    bins = 1 + (sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] // BIN_ROWS)
    targets = source_targets(
        sizes.select("source", (F.col("size") * F.col("count")).alias("size")), weights, share, ceiling
    )
    rows = rows.withColumn("bin", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(bins)))
    by_bin = Window.partitionBy("key", "size").orderBy("bin")
    starts = (
        rows.groupBy("key", "size", "bin")
        .agg(F.count("*").alias("in_bin"))
        .withColumn("earlier", F.sum("in_bin").over(by_bin) - F.col("in_bin"))
        .join(sizes.select("key", "size", "smaller"), ["key", "size"])
        .select("key", "size", "bin", (F.col("smaller") + F.col("earlier")).alias("before"))
    )
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    in_bin = Window.partitionBy("key", "size", "bin").orderBy("doc_id", "tie")
    # Only whole numbers of copies arise where a source is at its ceiling.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda place: F.floor(place * F.col("rate") + F.col("offset"))
    return (
        rows.withColumn("place", F.row_number().over(in_bin))
        .join(starts, ["key", "size", "bin"])
        .join(targets.drop("source"), "key")
        .withColumn("rate", rate)
        .withColumn("offset", random_offset(seed, F.col("source")))
        .withColumn("place", F.col("place") + F.col("before"))
        .withColumn("copies", crossed(F.col("place")) - crossed(F.col("place") - 1))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", *(["doc"] if carry else [])
        )
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` with their columns, each as often as the mix takes it."""
    drawn = sample_copies(docs, carry=True, **settings).where("copies > 0")
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
