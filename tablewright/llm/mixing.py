"""Mixing sources to target weights.

Sizes are summed per source (combined before the shuffle), targets follow from weights,
and a document is taken ``floor(rate)`` times plus once more with the probability of the
fraction, decided by a hash of seed and document. Nothing depends on partitions, so
reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import SPACE
from tablewright.operators.segments import with_running_index
from tablewright.storage import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3


def n_words(text: str | Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only: 48 bits of an md5."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in code point order, NULL last, weigh ``weights``, repeating. They share the
    sum of all sizes by weight; a target stops at ``cap`` times its source's size and the
    rest is shared again by weight until none is above. The loop ends because each turn
    caps at least one more source; only its sums reach the driver."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = with_running_index(materialize(totals, "sources"), [F.col("source").asc_nulls_last()], "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.withColumn("weight", pick).drop("rank"), "source-weights")
    limit = F.col("source_size") * cap
    share, held = 0.0, -1  # tokens per unit of weight; sources at their cap
    while True:
        full = F.lit(held >= 0) & (F.col("weight") * F.lit(share) >= limit)
        sums = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if sums["full"] == held or not sums["open"]:
            break
        held = sums["full"]
        share = (sums["all"] - sums["fixed"]) / sums["open"]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(share), limit.cast("double")).alias("target"))


def mix_counts(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken per row, and the columns ``keep``
    of ``docs`` as a struct ``row``.

    A document's rate is target over source size; sizes of 0 (NULL or empty text) give
    rate 0. A NULL source is a source of its own, after all others; a NULL id takes part
    like any other. Rows of one id and one text share their draw. An empty table gives an
    empty one."""
    base = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n_words(text_column).alias("size"),
        uniform(F.lit(seed), F.col(id_column), F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))).alias("draw"),
        *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []),
    )
    targets = source_targets(base.select("source", "size"), weights, cap).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("bigint")).cast("bigint")
    # Not hinted: Spark broadcasts the sources if it measures them as small.
    return (
        base.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep else []))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns."""
    counted = mix_counts(docs, keep=tuple(docs.columns), **options)
    return counted.where("copies > 0").select(F.col("row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
