"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import WORD, word_count, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and most epochs of a source.
SHARE, EPOCHS = 1.5, 2
SEED = "mix-1"
#: Hex digits of a document's draw that name its slice of the source: 4096 slices.
_DIGITS = 3


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row per source.

    The mix takes share * (all sizes); a source gets its weight's part of it, but at most
    epochs * source_size, and what capped sources leave is shared again by weight until
    none is above its cap. That fixed point gives every uncapped source weight * level with
    one level for all: sources are put in the order in which a rising level fills them, and
    the level is what the sources not yet full need to make up the rest.

    The windows run over the table of sources, one row each, never over documents. With
    share > epochs all sources are capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") * share - F.col("capped")) / (F.col("weights") - F.col("spent")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return filled.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weights=WEIGHTS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, taken) for docs(doc_id, text, source).

    One row for each distinct (doc_id, source, size); n is how many rows of docs it stands
    for (1 unless rows repeat). size: words of the text, 0 for null. taken: words the mix
    takes of each of those rows. A document is taken whole as often as its source's target
    is a whole multiple of the source's size; the fraction left over is a seeded draw:
    documents in the order of an MD5 of seed and doc_id are taken once more until the words
    are used up, the last of them in part. So a source's taken words are its target rounded
    (less at most a word for each repeated row), and no document exceeds `epochs` times its
    size. Runs agree. Null sources are one source, the last in order; null doc_ids draw
    alike. No rows, or no words at all, give targets of 0. Extra columns are not looked at.
    Of a text of any length only the number of words leaves the scan.

    A source's order is never sorted in one task: draws fall into 4096 slices of about
    equal rows, a small table has the words before each slice, and only slices are sorted.
    Repeated rows are combined before any shuffle.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    sized = (
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
    )
    sized = written(spark, sized.withColumn("draw", draw), "sizes").withColumn(
        "slice", F.substring("draw", 1, _DIGITS)
    )
    slices = sized.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    slices = written(spark, slices, "slices")
    sources = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    wanted = targets(sources, share, epochs, weights).withColumn("whole", whole)
    plan = slices.select(
        _key(F.col("source")).alias("s"),
        F.col("slice").alias("p"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"),
    ).join(wanted, F.col("s") == _key(F.col("source")))
    rest = goal - F.col("whole") * F.col("source_size") - F.col("ahead")
    plan = written(spark, plan.select("s", "p", "source_size", "target", "whole", rest.alias("rest")), "plan")
    # Equal keys for the join and the window: one shuffle of the short rows.
    joined = sized.withColumn("k", _key(F.col("source"))).join(
        plan, (F.col("k") == F.col("s")) & (F.col("slice") == F.col("p"))
    )
    order = Window.partitionBy("k", "slice").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size")
    words = F.col("size") * F.col("n")
    upto = F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0))
    more = F.greatest(F.lit(0), F.least(words, F.col("rest") - upto + words))
    taken = F.col("whole") * F.col("size") + F.floor(more / F.col("n"))
    return joined.select(
        "doc_id", "source", "size", "n", "source_size", "target", taken.cast("long").alias("taken")
    )


def read_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs as the mix reads them: a row for each epoch, the last cut to the words taken.

    mixed is what mix() returned for docs. A document of which nothing is taken, among them
    those without words, is left out. A cut keeps the white space before each word kept.
    All columns of docs stay as they are but the text of a cut row.
    """
    takes = mixed.where("taken > 0").select(
        F.col("doc_id").alias("_doc"),
        _key(F.col("source")).alias("_source"),
        F.col("size").alias("_size"),
        F.col("taken").alias("_taken"),
    )
    rows = docs.withColumn("_words", word_count(F.col("text"))).join(
        takes.hint("merge"),  # one plan at every size
        F.col("doc_id").eqNullSafe(F.col("_doc"))
        & (_key(F.col("source")) == F.col("_source"))
        & (F.col("_words") == F.col("_size")),
    )
    last = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(1), last)))
    left = F.col("_taken") - (F.col("_epoch") - 1) * F.col("_size")
    cut = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), left.cast("int"))
    text = F.when(left < F.col("_size"), F.array_join(cut, "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
