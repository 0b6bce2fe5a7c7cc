"""Metrics sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_metrics(metrics: DataFrame, path: str, fmt: str = "json", run_id: str | None = None) -> None:
    """Add result rows (``run, model, split, metric, value, params``) to the table at ``path``.

    With ``run_id`` the rows go to a folder of that run (column ``run_id`` when
    read), which a retried run replaces; without it every call adds its rows."""
    if run_id is None:
        metrics.write.mode("append").format(fmt).save(path)
    else:
        metrics.write.mode("overwrite").format(fmt).save(f"{path}/run_id={run_id}")
