"""Session set-up and the shared folder for tables a job writes for itself."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "thermocline") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _local_root(spark: SparkSession) -> str:
    """A folder that goes with the process; only for a session that is one process."""
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    base = context.getConf().get("spark.local.dir", "/tmp").split(",")[0]
    root = f"{base.rstrip('/')}/thermocline-{context.applicationId}"
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    Only a ``local`` session, whose driver and executors are one process, may leave it unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def together(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Results of independent jobs, run at the same time: cores that one job leaves idle, while it plans or waits for its last task, serve another."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)
