"""Token arrays in .npy files as a Spark data source, and a sink that streams tokens into such files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..ordinal import id_block, scan


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def files(path: str) -> list[str]:
    """The file, or the .npy files of a folder by name."""
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".npy"))
    return [path]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", 65_536))
        self.span = max(1, int(options.get("span", 16_777_216)) // self.chunk) * self.chunk

    def partitions(self):
        out = []
        for f in files(self.path):
            n = np.load(f, mmap_mode="r").shape[0]
            out += [_Slice(f, a, min(n, a + self.span)) for a in range(0, n, self.span)]
        return out or [_Slice("", 0, 0)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        tokens = np.load(part.path, mmap_mode="r")
        if tokens.ndim != 1:
            raise ValueError(f"{part.path} has {tokens.ndim} dimensions, not 1")
        for a in range(part.start, part.stop, self.chunk):
            piece = np.asarray(tokens[a : min(a + self.chunk, part.stop)])
            if piece.dtype.kind not in "iu" or (piece.dtype.kind == "i" and len(piece) and piece.min() < 0):
                raise ValueError(f"{part.path}: token ids must be integers and not negative")
            if len(piece) and piece.max() > 2**31 - 1:
                raise ValueError(f"{part.path}: token ids are too large")
            values = pa.array(piece.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path]), pa.array([a], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), values)], ["file", "start", "tokens"]
            )


class NpySource(DataSource):
    """Format "npy": one-dimensional integer arrays as rows `file`, `start`, `tokens` of up to `chunk` tokens, memory-mapped."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, start bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_npy(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("chunk", str(chunk)).load()


def _header(n: int, kind: type) -> bytes:
    """The header of an array of n tokens, always of 128 bytes, so that it can be written last."""
    head = f"{{'descr': '{np.dtype(kind).str}', 'fortran_order': False, 'shape': ({n},), }}"
    return b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + head.ljust(117).encode() + b"\n"


def write_streams(rows: DataFrame, folder: str, name: str, order: str, prefix: str, span: int = 16_777_216) -> list[tuple[str, int]]:
    """Writes all tokens of each group to one file `prefix_name.npy`, by many tasks; gives (file, tokens), at once.

    Where each row's tokens stand follows from running sums, so tasks write spans of some `span` tokens into a shared
    file at their place; headers and names come last. A task that runs again writes the same. Needs `tokens`; `folder`
    must be one that all executors share.
    """
    sized = rows.select(F.col(name).alias("_g"), F.col(order).alias("_o"), "tokens", F.size("tokens").cast("bigint").alias("_n"), F.coalesce(F.array_max("tokens"), F.lit(0)).alias("_top"))
    totals = [tuple(r) for r in sized.groupBy("_g").agg(F.sum("_n"), F.max("_top")).collect()]
    kinds = {g: np.uint32 if top > 65_535 else np.uint16 for g, _, top in totals}
    at = scan(sized.drop("_top"), ["_g"], id_block("_o"), ["_o"], "_r", {"_stop": "_n"})
    run_id = uuid4().hex
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, stop, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = tokens.values.to_numpy(zero_copy_only=False).astype(kinds[g])
                file = os.open(os.path.join(folder, f".{prefix}_{g}.{run_id}.part"), os.O_WRONLY | os.O_CREAT)
                try:
                    os.pwrite(file, values.tobytes(), 128 + (stop - len(values)) * values.itemsize)
                finally:
                    os.close(file)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    spans = at.where("_n > 0").repartition("_g", F.floor((F.col("_stop") - F.col("_n")) / span))
    spans.select("_g", "_stop", "tokens").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    out = []
    for g, n, _ in sorted(totals):
        part = os.path.join(folder, f".{prefix}_{g}.{run_id}.part")
        file = os.open(part, os.O_WRONLY | os.O_CREAT)
        os.pwrite(file, _header(n or 0, kinds[g]), 0)
        os.close(file)
        os.replace(part, os.path.join(folder, f"{prefix}_{g}.npy"))
        out.append((f"{prefix}_{g}.npy", n or 0))
    return out


def write_npy(rows: DataFrame, folder: str, name: list[str], order: list[str], prefix: str) -> DataFrame:
    """Writes the tokens of each group to a file `prefix_name1(_name2...).npy`; gives `file`, `n_tokens` (lazy: an action writes).

    A group is streamed in order by one task, batch by batch, and its header is written last. Ids beyond 65,535
    in a group make its file 32 bits wide. Numbers in names have five digits or more. A file is renamed when it is whole, so
    a task that runs again after a loss leaves no broken one. `folder` must be one that all executors share.
    """
    wide = rows.groupBy(*name).agg(F.max(F.coalesce(F.array_max("tokens"), F.lit(0))).alias("_top"))
    label = F.concat_ws("_", F.lit(prefix), *[F.format_string("%05d", F.col(c)) if dict(rows.dtypes)[c] in ("int", "bigint") else F.col(c) for c in name])
    named = rows.join(F.broadcast(wide), name).select(label.alias("_file"), (F.col("_top") > 65_535).alias("_wide"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "tokens")
    keys = [f"_o{i}" for i in range(len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        current, out, n, kind = None, None, 0, np.uint16
        done: list[tuple[str, int]] = []

        def close() -> None:
            if out is None:
                return
            out.seek(0)
            out.write(_header(n, kind))
            out.close()
            os.replace(out.name, os.path.join(folder, f"{current}.npy"))
            done.append((f"{current}.npy", n))

        for batch in batches:
            for f, w, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(batch.num_columns - 1)):
                if f != current:
                    close()
                    current, n, kind = f, 0, np.uint32 if w else np.uint16
                    out = open(os.path.join(folder, f".{f}.{uuid4().hex}.part"), "wb")  # noqa: SIM115
                    out.write(b" " * 128)
                values = tokens.values.to_numpy(zero_copy_only=False).astype(kind)
                out.write(values.tobytes())
                n += len(values)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["file", "n_tokens"])

    return named.repartition("_file").sortWithinPartitions("_file", *keys).mapInArrow(run, "file string, n_tokens bigint")
