"""Schemas of the data model and its enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SAMPLES = "node_idx int, sample_idx bigint, image array<float>, label bigint"
PARAMS = "node_id bigint, round int, tensor_id int, idx int, value float"
MESSAGES = (
    "message_type int, sender bigint, round bigint, sample_count bigint, "
    "tensors array<struct<tensor_id:bigint,encoding:int,values:array<float>>>"
)
TOPOLOGY = "nodes array<struct<id:string,host:string,port:int>>, links array<struct<source:string,target:string>>"
PEER_EVENTS = (
    "round int, fromNode int, toNode int, bytes bigint, pushDurationS double, success boolean, timestamp double, "
    "kind string, peerID string"
)

# The columns of the round log in file order, and the current version of their schema.
ROUND_LOG = (
    "round int, train_loss double, train_acc double, test_acc double, test_loss double, local_acc double, local_loss double, "
    "eval_test_s double, eval_local_s double, eval_total_s double, fwd_s double, bwd_s double, opt_s double, shuf_s double, "
    "gossip_push_s double, gossip_agg_s double, bytes_sent bigint, peak_rss_mb double, effective_cores double, throttled string, "
    "n_samples int, elapsed_s double, round_total_s double, timestamp timestamp_ntz, node_id int, condition string, "
    "bytes_received bigint, peers_reached int, peers_expected int, status string, schema_version int, wire_bytes_sent bigint, "
    "wire_bytes_received bigint, payload_bytes_sent bigint, payload_bytes_received bigint, peers_timed_out int, "
    "compute_threads int, achieved_freq_khz int, gossip_wait_s double, gossip_aggregate_s double, peers_churn_dropped int, "
    "train_acc_s double"
)
SCHEMA_VERSION = 5

# Message types, and the parameter tensors of the network in wire order with their sizes.
MESSAGE_TYPES = {0: "weightsFull", 1: "weightsDelta", 2: "heartbeat", 3: "roundComplete"}
TENSORS = [
    ("conv1W", 432), ("conv1B", 16), ("conv2W", 4608), ("conv2B", 32),
    ("conv3W", 18432), ("conv3B", 64), ("fcW", 2560), ("fcB", 10),
]


def dimension(spark: SparkSession, entries: dict[int, str], key: str, name: str) -> DataFrame:
    return spark.createDataFrame(sorted(entries.items()), T.StructType.fromDDL(f"{key} int, {name} string"))
