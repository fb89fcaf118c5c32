"""Sinks and readers of run telemetry: round log, peer events, run configuration."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import instrumented
from ..schemas import PEER_EVENTS, ROUND_LOG

#: Columns of which -1 means "not measured".
SENTINELS = [
    "bytes_received", "wire_bytes_sent", "wire_bytes_received", "payload_bytes_sent", "payload_bytes_received",
    "compute_threads", "achieved_freq_khz",
]


#: Columns that no run measures.
NEVER_MEASURED = ["bytes_received", "wire_bytes_received", "payload_bytes_received", "compute_threads", "achieved_freq_khz"]


def write_round_log(rounds: DataFrame, path: str) -> None:
    """One CSV with the fixed columns; null is an empty field and memory has three decimals."""
    names = T.StructType.fromDDL(ROUND_LOG).names
    if sorted(rounds.columns) != sorted(names):
        raise ValueError("the round log has fixed columns")
    rows = rounds.withColumn("peak_rss_mb", F.format_string("%.3f", "peak_rss_mb")).select(*names)
    rows.orderBy("node_id", "round").coalesce(1).write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss"
    ).csv(path)


def read_round_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUND_LOG).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def measured(rounds: DataFrame) -> DataFrame:
    """The log with null in place of -1, fit for averages."""
    return rounds.withColumns({c: instrumented(F.col(c)) for c in SENTINELS if c in rounds.columns})


def write_peer_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def read_peer_events(spark: SparkSession, path: str) -> DataFrame:
    """Peer events; a line without a kind is a push."""
    return spark.read.schema(PEER_EVENTS).json(path).withColumn("kind", F.coalesce("kind", F.lit("push")))


def push_summary(events: DataFrame) -> DataFrame:
    pushes = events.where("kind = 'push'")
    return pushes.groupBy("fromNode").agg(
        F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum("bytes").alias("bytes")
    )


def write_config(config: dict, path: str) -> None:
    """Pretty, with sorted keys, renamed into place; a file of the driver's."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temp = f"{path}.part"
    with open(temp, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True)
    os.replace(temp, path)


def summary_line(rounds: DataFrame) -> DataFrame:
    """One line a node: rounds, last loss, status."""
    last = F.max_by(F.struct("train_loss", "status"), "round")
    return rounds.groupBy("node_id").agg(
        F.format_string("node %d: %d rounds, loss %.4f, %s", F.col("node_id"), F.count(F.lit(1)), last["train_loss"], last["status"]).alias("line")
    )


def system_state() -> dict:
    """What the machine says about itself; None where it does not."""
    def read(path):
        try:
            with open(path) as f:
                return f.read().strip()
        except OSError:
            return None

    release = read("/etc/os-release") or ""
    name = next((x.split("=", 1)[1].strip('"') for x in release.splitlines() if x.startswith("PRETTY_NAME=")), None)
    return {
        "os": name, "kernel": read("/proc/sys/kernel/osrelease"), "online_cpus": read("/sys/devices/system/cpu/online"),
        "governor": read("/sys/devices/system/cpu/cpu0/cpufreq/scaling_governor"),
        "affinity_cores": len(os.sched_getaffinity(0)), "processors": os.cpu_count(),
    }


def usage() -> dict:
    import resource

    u = resource.getrusage(resource.RUSAGE_SELF)
    return {"cpu_s": u.ru_utime + u.ru_stime, "peak_rss_mb": u.ru_maxrss / 1024}
