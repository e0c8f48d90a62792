"""Samples as bytes for a wire: named arrays and scalars through Arrow; objects, records and complex numbers are refused."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa


def pack(sample: dict) -> bytes:
    """Arrays as raw bytes with their type and shape, everything else as JSON, nested dictionaries by path."""
    arrays: dict[str, np.ndarray] = {}

    def strip(x, path: str):
        if isinstance(x, (np.ndarray, np.generic)):
            a = np.asarray(x)
            if a.dtype.kind in "VOc":
                raise ValueError(f"{path}: {a.dtype} cannot be packed")
            arrays[path] = a
            return {"__array__": path, "dtype": a.dtype.str, "shape": a.shape, "scalar": isinstance(x, np.generic)}
        if isinstance(x, dict):
            return {"__dict__": [[k, strip(v, f"{path}/{k}")] for k, v in x.items()]}
        if isinstance(x, (list, tuple)):
            return [strip(v, f"{path}/{i}") for i, v in enumerate(x)]
        return x

    head = json.dumps(strip(sample, ""))
    batch = pa.record_batch({"path": pa.array(["", *arrays], pa.string()), "data": pa.array([head.encode(), *(np.ascontiguousarray(a).tobytes() for a in arrays.values())], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict:
    """The inverse of pack."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    held = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    def build(x):
        if isinstance(x, dict) and "__array__" in x:
            a = np.frombuffer(held[x["__array__"]], np.dtype(x["dtype"])).reshape(x["shape"])
            return a[()] if x["scalar"] else a.copy()
        if isinstance(x, dict):
            return {k: build(v) for k, v in x["__dict__"]}
        return [build(v) for v in x] if isinstance(x, list) else x

    return build(json.loads(held[""]))
