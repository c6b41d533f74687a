"""Records from a stream of changes: each micro-batch is one engine pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Batch, Engine, Outcome
from ..sources import schemas


def last_changes(batch: DataFrame) -> DataFrame:
    """(kind, key, source_stamp, body) of the last change of each record: the latest stamp, a missing one last of all,
    then the order of arrival in the column `arrived`, if there is one."""
    arrived = F.col("arrived") if "arrived" in batch.columns else F.lit(0)
    order = F.struct(F.coalesce("source_stamp", F.lit("9999-12-31").cast("timestamp")), arrived, F.coalesce("body", F.lit("")))
    return batch.groupBy("kind", "key").agg(F.max_by(F.struct("source_stamp", "body"), order).alias("r")).select("kind", "key", "r.*")


def apply_changes(engine: Engine, batch: DataFrame, at: dt.datetime | None = None) -> Outcome:
    """One micro-batch of (kind, key, source_stamp, body as JSON; no body deletes) as one pass.

    Late records are ordinary corrections, so nothing has a watermark: the store's stamps decide what lands. A kind or
    a body that the gate refuses refuses the batch, naming the first.
    """
    last = last_changes(batch).persist()
    try:
        unknown = last.where(~F.col("kind").isin(*engine.library.facts)).select("kind").first()
        if unknown is not None:
            raise schemas.Refused(f"no kind {unknown['kind']!r} is declared")
        for k, fact in engine.library.facts.items():
            refused = schemas.refusals(last.where(F.col("kind") == k), k, fact).agg(F.min("reason")).first()[0]
            if refused is not None:
                raise schemas.Refused(refused)
        kinds = [k for k in engine.library.facts if not last.where((F.col("kind") == k) & F.col("body").isNotNull()).isEmpty()]
        deleted = [r["kind"] for r in last.where(F.col("body").isNull()).select("kind").distinct().collect()]  # no more than there are kinds
        gone = {k: last.where((F.col("kind") == k) & F.col("body").isNull()).select("key") for k in deleted}
        writes = {k: schemas.from_json(last.where((F.col("kind") == k) & F.col("body").isNotNull()), engine.library.facts[k]) for k in kinds}
        return engine.apply(Batch(writes=writes, deletes=gone), at)
    finally:
        last.unpersist()


def run(engine: Engine, changes: DataFrame, checkpoint: str, clock: Callable[[], dt.datetime] | None = None, **trigger: object) -> StreamingQuery:
    """Start a query that feeds a stream of changes to the engine. A batch that was applied before is skipped."""

    def each(df: DataFrame, number: int) -> None:
        done = int(engine.store.pointers.get("#batch", "-1"))
        if number <= done:
            return
        engine.store.pointers["#batch"] = str(number)  # committed with the pass
        apply_changes(engine, df, clock() if clock else None)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
