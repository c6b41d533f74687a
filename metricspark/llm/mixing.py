"""Operator 2: mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Rows of a source that are ranked exactly at the boundary, about.
BUCKET_ROWS = 1000
#: Times that the words still missing at the boundary are filled with further documents.
FILLS = 3
#: A table of sources up to so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8_000_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with the target of each source.

    Sources are levelled like water: with them ordered by cap over weight, those below the level have their
    cap and the others the level times their weight. That is where resharing the excess again and again ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = (
        w.withColumn("total", F.lit(share) * F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("below", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("above", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce(F.col("below"), F.lit(0.0))) / F.col("above"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("first_open", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    )
    return w.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("first_open") * F.col("weight")))


def mix(docs: DataFrame, seed: int = 7, carry: bool = False) -> DataFrame:
    """Copies of each document that the mix takes; with `carry`, the rows of docs themselves, each as often as it is taken.

    A source's ratio is its target over its size. Each document is surely taken floor(ratio) times. The words
    still missing come from a Pareto sample: a document's inclusion probability grows with the bit length of
    its size, its rank is the odds of a uniform number (from the id and the seed) over the inclusion odds, and
    documents are taken in rank order while the words still fit. At the boundary, later documents of the same
    stretch of ranks fill what is missing, FILLS times. Ranks are cut into stretches of about BUCKET_ROWS
    documents, summed before they are shuffled; only the stretch with the boundary is sorted.

    A null text and one of white space have size 0 and take 0 words. Null sources are a source, the last.
    Rows that repeat an id have equal ranks and are taken by size. An empty table gives no rows.
    Gives doc_id, source, size, source_size, target, copies and taken. Carried rows are ranked where they lie, and
    only those of the stretch at the boundary are shuffled.
    """
    words = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count(F.col("text"), F.lit(WORD))).cast("long").alias("size")
    sized = cut(docs.select("doc_id", "source", words))
    base = docs.select("doc_id", "source", words, F.struct("*").alias("_row")) if carry else sized
    bits = F.length(F.bin(F.col("size"))).cast("long")
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"), F.sum(bits * F.col("size")).alias("bit_words"))))
    sources = (
        sources.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("ratio").cast("long"))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1), F.floor(F.col("source_rows") / F.lit(BUCKET_ROWS))).cast("long"))
        .select("source", "source_size", "target", "whole", "missing", "buckets", "bit_words")
    )
    held = sources.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0)).alias("b")).first()["b"]

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if held <= BROADCAST_BYTES else df

    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    chance = F.least(F.lit(0.98), F.col("missing") * bits / F.col("bit_words"))
    ranked = (
        base.alias("d")
        .join(small(sources.alias("s")), F.expr("d.source <=> s.source"))
        .select("d.*", "s.source_size", "s.target", "s.whole", "s.missing", "s.buckets", u.alias("u"), chance.alias("chance"))
        .withColumn("odds", F.when(F.col("chance") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))))
        .withColumn("bucket", F.when(F.col("odds").isNotNull() & (F.col("size") > 0), F.floor(F.col("odds") / (1 + F.col("odds")) * F.col("buckets")).cast("long")))
    )
    summed = ranked.where(F.col("bucket").isNotNull()).groupBy("source", "bucket", "missing").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket")
    crossing = (
        summed.withColumn("upto", F.sum("words").over(run))
        .where(F.col("upto") > F.col("missing"))
        .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
        .select("source", F.col("c.bucket").alias("edge"), F.col("c.before").alias("before"))
    )
    placed = ranked.alias("r").join(small(crossing.alias("c")), F.expr("r.source <=> c.source"), "left").select("r.*", "c.edge", "c.before")
    at_edge = F.col("bucket").isNotNull() & F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    sure = placed.where(~at_edge).withColumn("extra", F.when(F.col("bucket").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))), F.lit(1)).otherwise(F.lit(0)))

    part = Window.partitionBy("source", "bucket")
    order = part.orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(at_edge).withColumn("gap", F.col("missing") - F.col("before")).withColumn("extra", F.lit(0))
    for _ in range(1 + FILLS):
        edge = (
            edge.withColumn("fits", F.when((F.col("extra") == 0) & (F.col("size") <= F.col("gap")), F.col("size")).otherwise(F.lit(0)))
            .withColumn("upto", F.sum("fits").over(order))
            .withColumn("now", (F.col("fits") > 0) & (F.col("upto") <= F.col("gap")))
            .withColumn("extra", F.when(F.col("now"), F.lit(1)).otherwise(F.col("extra")))
            .withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("now"), F.col("upto"))).over(part), F.lit(0)))
        )
    kept = ["doc_id", "source", "size", "source_size", "target", "whole", "extra", *(["_row"] if carry else [])]
    copies = F.col("whole") + F.col("extra")
    if carry:
        taken = sure.select(kept).unionByName(edge.select(kept)).where(copies > 0)
        return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("_row.*")
    return sure.select(kept).unionByName(edge.select(kept)).withColumn("copies", copies.cast("long")).withColumn("taken", (copies * F.col("size")).cast("long")).drop("whole", "extra")
