"""Read-only tables of numbers for Python tasks: a vectorised hash table, and arrays that the
executors fetch from the shared folder once and map into memory."""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
from pyspark.sql import SparkSession

from logsieve.session import checkpoint_dir

MISSING = -1


class KeyTable:
    """int64 keys -> int64 values >= 0, looked up for whole arrays.  One probe in a table of
    slots; keys that lost their slot to another are found in a short sorted rest."""

    PARTS = ("keys", "values", "crowded", "rest_keys", "rest_values")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.keys, self.values, self.crowded, self.rest_keys, self.rest_values = (parts[p] for p in self.PARTS)
        self.shift = np.uint64(64 - (len(self.keys).bit_length() - 1))

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> KeyTable:
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        bits = max(8, (max(1, len(keys)) * 8).bit_length())
        slots = np.full(1 << bits, -2**63, np.int64)
        held = np.full(1 << bits, MISSING, np.int64)
        crowded = np.zeros(1 << bits, bool)
        at = cls.slot(keys, np.uint64(64 - bits))
        slots[at] = keys
        lost = slots[at] != keys
        held[at[~lost]] = values[~lost]
        crowded[at[lost]] = True
        order = np.argsort(keys[lost], kind="stable")
        return cls({"keys": slots, "values": held, "crowded": crowded,
                    "rest_keys": np.append(keys[lost][order], np.int64(2**63 - 1)),
                    "rest_values": np.append(values[lost][order], np.int64(MISSING))})

    @staticmethod
    def slot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.reshape(-1)
        at = self.slot(flat, self.shift)
        out = np.where(self.keys[at] == flat, self.values[at], MISSING)
        again = np.flatnonzero(self.crowded[at] & (out == MISSING))
        if len(again):
            k = flat[again]
            i = np.searchsorted(self.rest_keys, k)
            out[again] = np.where(self.rest_keys[i] == k, self.rest_values[i], MISSING)
        return out.reshape(keys.shape)


def byte_matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)


def share_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Write the arrays to the shared checkpoint folder and have every executor fetch the
    file when a task first needs it; returns the name for `mapped_arrays`."""
    sc = spark.sparkContext
    name = f"arrays-{uuid.uuid4().hex}.bin"
    data = io.BytesIO()
    for key, value in arrays.items():
        body = np.ascontiguousarray(value)
        head = f"{key} {body.dtype.str} {' '.join(map(str, body.shape))}\n".encode()
        data.write(head.rjust(256 * (-(-len(head) // 256))))
        data.write(body.tobytes())
        data.write(bytes(-body.nbytes % 256))
    path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addFile(path.toString())
    return name


def mapped_arrays(name: str) -> dict[str, np.ndarray]:
    """In a task: the arrays, mapped from the executor's copy of the file."""
    from pyspark import SparkFiles
    path = SparkFiles.get(name)
    out, at, size = {}, 0, os.path.getsize(path)
    while at < size:
        with open(path, "rb") as f:
            f.seek(at)
            head = f.read(256)
            while not head.endswith(b"\n"):
                head += f.read(256)
        key, kind, *shape = head.decode().split()
        shape = tuple(map(int, shape))
        at += len(head)
        count = int(np.prod(shape)) if shape else 1
        out[key] = np.memmap(path, np.dtype(kind), "r", at, shape) if count else np.zeros(shape, np.dtype(kind))
        at += count * np.dtype(kind).itemsize
        at += -at % 256
    return out
