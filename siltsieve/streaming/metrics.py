"""Rows, rates, durations, failures and latencies of running queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


PROBES, PROBE_EVERY = "probes", 100


def probed(sdf: DataFrame, arrived: str = "arrived", tid: str = "tid", every: int = PROBE_EVERY) -> DataFrame:
    """sdf, with every so many tuples one as a probe: when they arrived (a timestamp) is observed, so a Throughput knows how long they took to the end of their micro-batch. The oldest are kept as a percentile, however many there are."""
    at = F.when(F.col(tid) % every == 0, F.unix_millis(arrived))
    return sdf.observe(PROBES, F.count(at).alias("n"), F.percentile_approx(at, 0.05, 1000).alias("old"))


class Throughput(StreamingQueryListener):
    """Keeps (batch, rows in, rows a second, milliseconds) of every micro-batch; add with spark.streams.addListener."""

    def __init__(self) -> None:
        self.batches: list[tuple[int, int, float, int]] = []
        self.failures: list[str] = []
        self.probes = 0
        self.latencies: list[float] = []  # 95th percentiles of micro-batches' probes, in milliseconds

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.batches.append((p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration))
        found = (p.observedMetrics or {}).get(PROBES)
        if found and found.n:
            began = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1000
            self.probes += found.n
            self.latencies.append(began + p.batchDuration - found.old)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.failures.append(event.exception)

    @property
    def rows(self) -> int:
        return sum(b[1] for b in self.batches)

    def report(self) -> dict[str, float]:
        """Totals so far: batches, rows, failures, rows a second while batches ran, the 95th percentile of their milliseconds; of probes (see probed) their number and the largest of the micro-batches' 95th percentiles of latency."""
        took = sorted(b[3] for b in self.batches)
        seconds = sum(took) / 1000
        return {"batches": len(took), "rows": self.rows, "failures": len(self.failures), "rows_per_second": self.rows / seconds if seconds else 0.0, "p95_ms": took[min(len(took) - 1, int(0.95 * len(took)))] if took else 0, "probes": self.probes, "probe_p95_ms": max(self.latencies, default=0.0)}
