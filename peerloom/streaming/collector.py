"""Stateful streams: the round collector (barrier, deadline, late data) and the liveness monitor.

A receiver works through its rounds in order. A round closes when all expected
senders have written, or when the deadline has passed since the round before it
closed (the first one: since the receiver's first message). Use the RocksDB
state store on a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.frames import decode_frames

OUTPUT = "receiver long, round long, status string, senders array<long>, missing array<long>, sample_count long"
#: The open round, when it began, and the messages kept for it and for later ones.
STATE = "open long, began long, rounds array<long>, senders array<long>, samples array<long>"


def collect_rounds(
    messages: DataFrame, expected: dict[int, list[int]], deadline_ms: int | None = None, last_round: int | None = None
) -> DataFrame:
    """One row for each (receiver, round) when all expected senders have written, or when the deadline passes.

    messages: receiver, round (from 1), sender, sample_count. A later message of a sender replaces its earlier
    one. Early messages wait for their round; those of closed rounds and of senders that are not expected are
    discarded. A round without any message times out too. State holds the open and later rounds only, and after
    ``last_round`` nothing but the round's number. ``expected`` maps a receiver to its peers (the topology, a
    parameter of the run); a receiver that is not in it is ignored.
    """

    def step(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        receiver = key[0]
        if receiver not in expected:
            return
        want, now = set(expected[receiver]), state.getCurrentProcessingTimeMs()
        open_, began, *kept = state.get if state.exists else (1, now, [], [], [])
        have = {(r, s): n for r, s, n in zip(*kept)}
        for pdf in batches:
            for r, s, n in zip(pdf["round"].tolist(), pdf["sender"].tolist(), pdf["sample_count"].tolist()):
                if r >= open_ and s in want and (last_round is None or r <= last_round):
                    have[int(r), int(s)] = int(n)
        out = []
        while last_round is None or open_ <= last_round:
            got = {s: n for (r, s), n in have.items() if r == open_}
            full = want <= set(got)
            late = deadline_ms is not None and now >= began + deadline_ms
            if not full and not late or not want and not state.exists and len(out) > 0:
                break
            status = "completed" if full else "timed_out"
            out.append((receiver, open_, status, sorted(got), sorted(want - set(got)), sum(got.values())))
            have = {k: n for k, n in have.items() if k[0] > open_}
            open_, began = open_ + 1, now
            if not want:  # a node alone has nothing to wait for: one round a message
                break
        rows = sorted((r, s, n) for (r, s), n in have.items())
        state.update((open_, began, [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows]))
        # Spark forgets the timeout on every call, so what is left of it is set again.
        if deadline_ms is not None and (last_round is None or open_ <= last_round):
            state.setTimeoutDuration(max(1, began + deadline_ms - now))
        yield pd.DataFrame(out, columns=["receiver", "round", "status", "senders", "missing", "sample_count"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if deadline_ms is not None else GroupStateTimeout.NoTimeout
    return messages.groupBy("receiver").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def liveness(probes: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(address, at, up) whenever an address changes state; every address starts down. probes: address, at, up.

    With ``forget_ms``, an address that is silent for so long counts as down (``at`` is then the processing time) and
    leaves the state.
    """

    def step(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        up = state.get[0] if state.exists else False
        out = []
        if state.hasTimedOut:
            state.remove()
            if up:
                out.append((key[0], pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms"), False))
        else:
            for pdf in batches:
                for at, now in pdf.sort_values("at")[["at", "up"]].itertuples(index=False):
                    if bool(now) != up:
                        up = bool(now)
                        out.append((key[0], at, up))
            state.update((up,))
            if forget_ms is not None:
                state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["address", "at", "up"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms is not None else GroupStateTimeout.NoTimeout
    return probes.groupBy("address").applyInPandasWithState(step, "address string, at timestamp, up boolean", "up boolean", "append", timeout)


def frames_of(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the binary frame files that arrive in a folder with a subfolder for each receiver, ``<folder>/<receiver>/<file>``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("recursiveFileLookup", True).load(folder)
    receiver = F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).try_cast("long")
    return found.select(receiver.alias("receiver"), "content", F.col("modificationTime").alias("at"))


def inbound(spark: SparkSession, folder: str) -> DataFrame:
    """The messages in those frames (receiver, message_type, sender, round, sample_count, tensors), without what cannot be read."""
    return decode_frames(frames_of(spark, folder), keep=["receiver"]).where("corrupt is null").drop("corrupt")


def rounds_of(
    spark: SparkSession, folder: str, expected: dict[int, list[int]], deadline_ms: int | None = None, last_round: int | None = None
) -> DataFrame:
    """From files to rounds: frames, messages, collector."""
    return collect_rounds(inbound(spark, folder).select("receiver", "round", "sender", "sample_count"), expected, deadline_ms, last_round)
