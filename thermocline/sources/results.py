"""Sinks of evaluation results."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame

from thermocline.session import together


def save_results(frames: Mapping[str, DataFrame], path: str) -> None:
    """Each frame as JSON lines under its name; ``summary`` as CSV with a header as well. The tables are written at the same time."""
    jobs = [partial(frame.write.mode("overwrite").json, f"{path}/{name}") for name, frame in frames.items()]
    if "summary" in frames:
        jobs.append(partial(frames["summary"].write.mode("overwrite").csv, f"{path}/summary_table", header=True))
    if jobs:
        together(next(iter(frames.values())).sparkSession, jobs)
