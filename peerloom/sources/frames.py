"""Binary message frames: encode, split and decode.

A frame is a 4-byte little-endian length and a message: a 28-byte header, then
for each tensor a 12-byte header and its payload.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions.codec import DENSE, FP16, INT8, SPARSE
from ..schemas import MESSAGES

# Message layout.
MAGIC, VERSION = 0x4C465247, 1
HEADER = struct.Struct("<IHHIIIII")  # magic, version, type, sender, round, samples, tensors, reserved
TENSOR = struct.Struct("<III")  # id, encoding, dense element count
MAX_FRAME = 64 << 20


def encode(message: dict) -> bytes:
    """Bytes of a message (message_type, sender, round, sample_count, tensors), without the length."""
    import numpy as np

    out = [HEADER.pack(MAGIC, VERSION, message["message_type"], message["sender"], message["round"], message["sample_count"],
                       len(message["tensors"]), 0)]
    for t in message["tensors"]:
        v = np.asarray(t["values"], dtype="<f4")
        out.append(TENSOR.pack(t["tensor_id"], t["encoding"], len(v)))
        if t["encoding"] == DENSE:
            out.append(v.tobytes())
        elif t["encoding"] == FP16:
            out.append(v.astype("<f2").tobytes())
        elif t["encoding"] == INT8:
            low, high = (v.min(), v.max()) if len(v) else (np.float32(0), np.float32(0))
            scale = np.float32((high - low) / np.float32(255)) if high > low else np.float32(1)
            # Steps in single precision, halves away from zero in double: 0.5 added in single would lift 0.49999997.
            q = np.clip(np.floor(((v - low) / scale).astype(np.float64) + 0.5), 0, 255).astype(np.uint8)
            out += [struct.pack("<ff", low, scale), q.tobytes()]
        elif t["encoding"] == SPARSE:
            at = np.flatnonzero(v != 0).astype("<u4")
            out += [struct.pack("<I", len(at)), at.tobytes(), v[at].tobytes()]
        else:
            raise CodecError(f"encoding {t['encoding']} is not known")
    return b"".join(out)


def frame(message: dict) -> bytes:
    body = encode(message)
    return struct.pack("<I", len(body)) + body


def split(stream: bytes) -> tuple[list[bytes], bytes]:
    """Whole messages at the head of a stream, and the rest that waits for more bytes."""
    out, at = [], 0
    while len(stream) - at >= 4:
        (size,) = struct.unpack_from("<I", stream, at)
        if size > MAX_FRAME:
            raise CodecError(f"a frame of {size} bytes")
        if len(stream) - at - 4 < size:
            break
        out.append(stream[at + 4 : at + 4 + size])
        at += 4 + size
    return out, stream[at:]


def decode(body: bytes) -> dict:
    import numpy as np

    def take(fmt, n, at):
        size = np.dtype(fmt).itemsize * n
        if at + size > len(body):
            raise CodecError("the message is cut off")
        return np.frombuffer(body, dtype=fmt, count=n, offset=at), at + size

    if len(body) < HEADER.size:
        raise CodecError("the header is cut off")
    magic, version, kind, sender, round_no, samples, count, _ = HEADER.unpack_from(body)
    if magic != MAGIC or version != VERSION or kind not in range(4):
        raise CodecError("magic, version or type is not known")
    at, tensors = HEADER.size, []
    for _ in range(count):
        if at + TENSOR.size > len(body):
            raise CodecError("a tensor header is cut off")
        tid, enc, n = TENSOR.unpack_from(body, at)
        at += TENSOR.size
        if enc == DENSE:
            v, at = take("<f4", n, at)
        elif enc == FP16:
            v, at = take("<f2", n, at)
        elif enc == INT8:
            (low, scale), at = take("<f4", 2, at)
            q, at = take("u1", n, at)
            v = low + q.astype("<f4") * scale
        elif enc == SPARSE:
            (nnz,), at = take("<u4", 1, at)
            if nnz > n:
                raise CodecError("more entries than elements")
            ids, at = take("<u4", int(nnz), at)
            vals, at = take("<f4", int(nnz), at)
            v = np.zeros(n, dtype="<f4")
            ok = ids < n
            v[ids[ok]] = vals[ok]
        else:
            raise CodecError(f"encoding {enc} is not known")
        tensors.append({"tensor_id": tid, "encoding": enc, "values": v.astype("<f4").tolist()})
    return {"message_type": kind, "sender": sender, "round": round_no, "sample_count": samples, "tensors": tensors}


def decode_frames(blobs: DataFrame, column: str = "content", fail_fast: bool = False, keep: list[str] = ()) -> DataFrame:
    """One row a message of every binary blob of frames, with the columns in ``keep``; what cannot be read is named in ``corrupt``."""
    own = [f"{f.name} {f.dataType.simpleString()}" for f in blobs.select(*keep).schema.fields] if keep else []
    schema = ", ".join([*own, MESSAGES, "corrupt string"])

    def run(batches):
        import pandas as pd

        names = [*keep, "message_type", "sender", "round", "sample_count", "tensors", "corrupt"]
        for pdf in batches:
            rows = []
            for blob, *own in zip(pdf[column], *(pdf[k] for k in keep)):
                out = []
                rows.append((own, out))
                try:
                    bodies, rest = split(bytes(blob))
                    if rest:
                        bodies.append(rest[4:])
                except CodecError as e:
                    bodies, rest = [], b""
                    out.append({"corrupt": str(e)})
                for body in bodies:
                    try:
                        out.append(decode(body))
                    except CodecError as e:
                        if fail_fast:
                            raise
                        out.append({"corrupt": str(e)})
            found = [dict(zip(keep, own)) | r for own, out in rows for r in out]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in found], columns=names, dtype=object)

    return blobs.select(column, *keep).mapInPandas(run, schema)


def encode_frames(messages: DataFrame) -> DataFrame:
    """(sender, round, content): the frame of every message."""

    @F.pandas_udf("binary")
    def run(kind, sender, round_no, samples, tensors):
        import pandas as pd

        rows = zip(kind, sender, round_no, samples, tensors)
        return pd.Series([
            frame({"message_type": k, "sender": s, "round": r, "sample_count": n, "tensors": list(t)}) for k, s, r, n, t in rows
        ])

    return messages.select(
        "sender", "round", run("message_type", "sender", "round", "sample_count", "tensors").alias("content")
    )
