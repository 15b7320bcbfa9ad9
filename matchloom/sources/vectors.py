"""Reader of matrices in NumPy's file format, row ranges at a time."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .shared import qualified

#: Rows that one task reads at once.
ROWS = 16_384


def npy_header(file) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type of the numbers, shape, and where they begin, of an open file."""
    head = file.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a NumPy file")
    wide = head[6] > 1  # later versions give the header's length in four bytes
    size = struct.unpack_from("<I" if wide else "<H", head, 8)[0]
    start = 12 if wide else 10
    told = ast.literal_eval(file.read_at(size, start).decode())
    if told["fortran_order"]:
        raise ValueError("a matrix stored by columns")
    return np.dtype(told["descr"]), tuple(told["shape"]), start + size


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row (from 0) and embedding (array<float>) of a two-dimensional matrix. The driver reads the header alone."""
    path = qualified(spark, path)
    filesystem, name = fs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as file:
        kind, shape, start = npy_header(file)
    if len(shape) != 2:
        raise ValueError(f"a matrix is expected, not an array of shape {shape}")
    rows, dims = shape
    width = kind.itemsize * dims

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, name = fs.FileSystem.from_uri(path)
        with filesystem.open_input_file(name) as file:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    first, n = part * ROWS, min(ROWS, rows - part * ROWS)
                    matrix = np.frombuffer(file.read_at(n * width, start + first * width), kind).astype(np.float32)
                    ends = pa.array(np.arange(0, n * dims + 1, dims), pa.int32()) if dims else pa.array(np.zeros(n + 1), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(matrix))], ["row", "embedding"])

    parts = -(-rows // ROWS)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(read, "row long, embedding array<float>")
