"""``.npy`` arrays as a Spark data source: ``spark.read.format("npy").load(path)``.

Rows are (idx, values) for float arrays and (idx, label) for integer ones;
``values`` is one array element along the first axis, flattened. A partition
is a range of rows of one file, read through a memory map, so a task touches
only its own pages (``strategy`` eager: with one read instead). Options: ``rows`` (of a
partition), ``shape`` (expected, comma-separated, without the first axis), ``dtype``
(expected, <f4 or <i8), ``strategy`` (mapped or eager). Paths must be visible to every
executor, as with any file source.

Written rows are (name, values): an array of longs or ints becomes <i8, any other <f4.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import NpyError, ShardError
from ..schemas import TENSORS

# The file magic and the two element types that may be read.
MAGIC = b"\x93NUMPY"
KINDS = {"<f4": "float", "<i8": "long"}


def header(path: str) -> tuple[str, tuple[int, ...], int]:
    """(descr, shape, offset of the data); refuses everything but C-ordered <f4 and <i8 of the exact size."""
    with open(path, "rb") as f:
        head = f.read(8)
        if head[:6] != MAGIC:
            raise NpyError(f"{path}: not an npy file")
        if head[6] not in (1, 2, 3):
            raise NpyError(f"{path}: version {head[6]} is not known")
        width = 2 if head[6] == 1 else 4
        size = int.from_bytes(f.read(width), "little")
        text = f.read(size).decode("latin-1")
    if len(text) < size:
        raise NpyError(f"{path}: the header is cut off")
    descr = re.search(r"'descr'\s*:\s*'([^']*)'", text)
    order = re.search(r"'fortran_order'\s*:\s*(True|False)", text)
    shape = re.search(r"'shape'\s*:\s*\(([^)]*)\)", text)
    if not (descr and order and shape):
        raise NpyError(f"{path}: the header lacks a field")
    if descr[1] not in KINDS:
        raise NpyError(f"{path}: elements of type {descr[1]}")
    if order[1] == "True":
        raise NpyError(f"{path}: Fortran order")
    dims = tuple(int(x) for x in shape[1].split(",") if x.strip())
    at = 8 + width + size
    count = 1
    for d in dims:
        count *= d
    if os.path.getsize(path) - at != count * int(descr[1][2:]):
        raise NpyError(f"{path}: the data has another size than the header says")
    return descr[1], dims, at


class Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _paths(self) -> list[str]:
        path = self.options.get("path", "")
        found = sorted(glob.glob(os.path.join(path, "*.npy") if os.path.isdir(path) else path))
        if not found:
            raise NpyError(f"{path}: no such file")
        return found

    def schema(self) -> str:
        kinds = {header(p)[0] for p in self._paths()}
        if len(kinds) > 1:
            raise NpyError("the files hold elements of different types")
        return "file string, idx long, " + ("values array<float>" if kinds == {"<f4"} else "label long")

    def reader(self, schema) -> NpyReader:
        return NpyReader(self._paths(), self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite)


class NpyReader(DataSourceReader):
    def __init__(self, paths: list[str], options):
        self.paths, self.rows = paths, int(options.get("rows", 4096))
        shape, self.dtype, self.strategy = options.get("shape"), options.get("dtype"), options.get("strategy", "mapped")
        self.shape = tuple(int(x) for x in shape.split(",")) if shape else None
        if self.strategy not in ("mapped", "eager"):
            raise NpyError(f"strategy {self.strategy} is not mapped or eager")

    def partitions(self) -> list[Rows]:
        out = []
        for p in self.paths:
            descr, dims, _ = header(p)
            if self.dtype is not None and descr != self.dtype:
                raise NpyError(f"{p}: elements of type {descr}, but {self.dtype} is expected")
            if self.shape is not None and dims[1:] != self.shape:
                raise NpyError(f"{p}: shape {dims}, but {self.shape} is expected after the first axis")
            n = dims[0] if dims else 1
            out += [Rows(p, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out

    def read(self, part: Rows) -> Iterator:
        """Arrow batches over the file's own bytes."""
        import numpy as np
        import pyarrow as pa

        descr, dims, at = header(part.path)
        n, size = part.stop - part.start, int(np.prod(dims[1:], dtype=np.int64))
        if self.strategy == "mapped":
            data = np.memmap(part.path, dtype=descr, mode="r", offset=at + part.start * size * int(descr[2:]), shape=(n * size,))
        else:
            data = np.fromfile(part.path, dtype=descr, offset=at + part.start * size * int(descr[2:]), count=n * size)
        name = os.path.basename(part.path)
        step = max(1, (1 << 22) // max(1, size))
        for a in range(0, n, step):
            z = min(n, a + step)
            flat = pa.array(np.asarray(data[a * size : z * size]))
            if descr == "<f4":
                value = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * size), flat)
            else:
                value = flat
            index = np.arange(part.start + a, part.start + z, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (z - a)), pa.array(index), value],
                                             names=["file", "idx", "values" if descr == "<f4" else "label"])


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class NpyWriter(DataSourceWriter):
    """One file of <f4 or <i8 for each row (name, values): small tensors, written whole and renamed into place.
    A name may hold folders. In overwrite mode the files of earlier writes go once all new ones are there."""

    def __init__(self, path: str, schema, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite
        element = schema["values"].dataType.elementType.simpleString()
        self.dtype = "<i8" if element in ("bigint", "int", "smallint", "tinyint") else "<f4"

    def write(self, rows) -> Written:
        files = []
        for r in rows:
            files.append(os.path.join(self.path, f"{r['name']}.npy"))
            os.makedirs(os.path.dirname(files[-1]), exist_ok=True)
            save(files[-1], r["values"], self.dtype)
        return Written(files)

    def commit(self, messages) -> None:
        new = {f for m in messages if m for f in m.files}
        for old in glob.glob(os.path.join(self.path, "**", "*.npy"), recursive=True) if self.overwrite else []:
            if old not in new:
                os.remove(old)

    def abort(self, messages) -> None:
        for f in (f for m in messages if m for f in m.files):
            os.remove(f)


def save(path: str, values, dtype: str = "<f4") -> None:
    """Version 1.0, header padded to 64 bytes, one axis or that of an ndarray; atomic."""
    import numpy as np

    temp = f"{path}.{os.getpid()}.part"
    with open(temp, "wb") as f:
        np.lib.format.write_array(f, np.ascontiguousarray(values, dtype=dtype), version=(1, 0))
    os.replace(temp, path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def train_shards(spark: SparkSession, folder: str, nodes: int | None = None, strategy: str = "mapped") -> DataFrame:
    """samples(node_idx, sample_idx, image, label) of all nodes, or of one; images and labels must match one to one."""
    register(spark)
    pick = "*" if nodes is None else f"{nodes:02d}"
    read = lambda kind, dtype: spark.read.format("npy").option("strategy", strategy).option("dtype", dtype).load(f"{folder}/node_{pick}_train_{kind}.npy")
    x, y = read("X", "<f4"), read("y", "<i8")
    node = F.regexp_extract("file", r"node_(\d+)_", 1).cast("int").alias("node_idx")
    x = x.select(node, F.col("idx").alias("sample_idx"), F.col("values").alias("image"))
    y = y.select(node, F.col("idx").alias("sample_idx"), "label")
    return paired(x, y, ["node_idx", "sample_idx"])


def test_set(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    x = spark.read.format("npy").load(f"{folder}/test_X.npy").select(F.col("idx").alias("sample_idx"), F.col("values").alias("image"))
    y = spark.read.format("npy").load(f"{folder}/test_y.npy").select(F.col("idx").alias("sample_idx"), "label")
    return paired(x, y, ["sample_idx"])


def paired(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Join images and labels by position; reading a position that only one side has is an error."""
    x, y = images.withColumn("__pl_x", F.lit(1)), labels.withColumn("__pl_y", F.lit(1))
    lone = F.raise_error(F.concat_ws(" ", F.lit(f"{ShardError.__name__}: images and labels differ at"), *[F.col(k).cast("string") for k in keys]))
    both = x.join(y, keys, "full_outer").withColumn("__pl_ok", F.when(F.col("__pl_x").isNull() | F.col("__pl_y").isNull(), lone.cast("int")).otherwise(1))
    return both.where("__pl_ok = 1").drop("__pl_x", "__pl_y", "__pl_ok")


def save_weights(params: DataFrame, path: str) -> None:
    """``<path>/node_<NN>/<tensor>.npy`` for every node's final parameters (node_id, tensor_id, values), each with one axis.

    Tensors have the network's names if there are as many of them, else ``tensor_<i>``.
    """
    register(params.sparkSession)
    fixed = F.element_at(F.array(*[F.lit(n) for n, _ in TENSORS]), F.col("tensor_id") + 1)
    many = params.groupBy("node_id").agg(F.count(F.lit(1)).alias("__pl_n"))
    tensor = F.when(F.col("__pl_n") == len(TENSORS), fixed).otherwise(F.concat(F.lit("tensor_"), "tensor_id"))
    node = F.concat(F.lit("node_"), F.lpad(F.col("node_id").cast("string"), F.greatest(F.lit(2), F.length(F.col("node_id").cast("string"))), F.lit("0")))
    rows = params.join(many, "node_id").select(F.concat_ws("/", node, tensor).alias("name"), F.col("values").cast("array<float>").alias("values"))
    rows.write.format("npy").mode("overwrite").save(path)
