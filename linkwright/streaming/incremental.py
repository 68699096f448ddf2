"""Batch-at-a-time linkage of a stream: every micro-batch runs the batch plan against the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkwright.operators.store import Store
from linkwright.plans.pipeline import all_records, run


def link_stream(csv_rows: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upserts recruiter rows (with ext_seq) into the store as they come; a batch that is repeated after a failure gives the same ids."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            run(all_records(csv=batch), store)

    return csv_rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
