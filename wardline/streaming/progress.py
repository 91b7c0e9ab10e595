"""How far a job is: counts taken on the way, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counts(skipped: Column | None = None, failed: Column | None = None) -> list[Column]:
    """Rows seen, skipped and failed, as metrics."""
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False))) if c is not None else F.lit(0).cast("long")
    zero = F.sum(F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("rows"), (of(skipped) if skipped is not None else F.coalesce(zero, F.lit(0).cast("long"))).alias("skipped"), (of(failed) if failed is not None else F.coalesce(zero, F.lit(0).cast("long"))).alias("failed")]


def observed(df: DataFrame, name: str | Observation, skipped: Column | None = None, failed: Column | None = None) -> DataFrame:
    """``df``, whose rows are counted as whatever it is part of runs; an Observation tells a batch job, a name the listener of a stream."""
    return df.observe(name, *counts(skipped, failed))


class Progress(StreamingQueryListener):
    """Totals of observed streams by name, and a call after each batch.

    ``tell`` gets name, batch number and the totals so far. A batch that is run
    again after a failure counts once, by its number.
    """

    def __init__(self, tell=None):
        self.tell, self.batches = tell, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.batches.setdefault(name, {})[event.progress.batchId] = row.asDict()
            if self.tell:
                self.tell(name, event.progress.batchId, self.totals(name))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self, name: str) -> dict[str, int]:
        """rows, skipped and failed of all batches of a stream."""
        seen = self.batches.get(name, {}).values()
        return {k: sum(b[k] for b in seen) for k in ("rows", "skipped", "failed")}
