"""Fixed-width float32 matrices as a Spark data source, and archives of named tensors as a checked scan.

``float32`` reads a ``.npy`` file or a folder that it wrote: byte ranges are its partitions, a row is its
place and a vector. A folder's manifest has each part's rows and checksum; a part or file whose size isn't
what its header or manifest says is refused before anything is read. ``.schema("row long")`` reads no bytes.
Paths are what pyarrow's file systems open: local or mounted files, and stores by their URI.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.joins import ContractError

RANGE_BYTES = 32 << 20
MANIFEST = "_manifest.json"
SCHEMA = "row long, vector array<float>"


def _opened(path: str):
    """File system and path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _size(path: str) -> int:
    system, at = _opened(path)
    info = system.get_file_info(at)
    if not info.is_file:
        raise ContractError(f"{path} is missing")
    return info.size


def _read(path: str, start: int, n: int) -> bytes:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(n)


def _forget(path: str) -> None:
    system, at = _opened(path)
    if system.get_file_info(at).is_file:
        system.delete_file(at)


@dataclass
class Part:
    """Rows of a file: where they begin in bytes, how many, and the first one's place."""

    path: str
    start: int
    rows: int
    first: int


def layout(path: str) -> tuple[int, list[Part]]:
    """Width and parts, checked against the sizes of the files."""
    system, at = _opened(path)
    if path.endswith(".npy"):
        head = io.BytesIO(_read(path, 0, 65_536))
        version = np.lib.format.read_magic(head)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if kind != np.dtype("<f4") or fortran or len(shape) != 2:
            raise ContractError(f"{path} holds {kind} of shape {shape}, not rows of float32")
        width, parts = shape[1], [Part(path, head.tell(), shape[0], 0)]
    else:
        with system.open_input_file(f"{at.rstrip('/')}/{MANIFEST}") as f:
            found = json.loads(f.read())
        width, parts, first = found["width"], [], 0
        for p in found["parts"]:
            parts.append(Part(f"{path.rstrip('/')}/{p['file']}", 0, p["rows"], first))
            first += p["rows"]
    for p in parts:
        if (size := _size(p.path)) != p.start + 4 * width * p.rows:
            raise ContractError(f"{p.path} has {size} bytes, not {p.start + 4 * width * p.rows}: truncated or changed")
    return width, parts


def ranges(width: int, parts: list[Part], most: int = RANGE_BYTES) -> list[Part]:
    step = max(1, most // max(1, 4 * width))
    return [Part(p.path, p.start + 4 * width * k, min(step, p.rows - k), p.first + k) for p in parts for k in range(0, p.rows, step)]


class Range(InputPartition):
    def __init__(self, part: Part, width: int):
        self.part, self.width = part, width


class Float32Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], most: int):
        self.path, self.names, self.most = path, names, most

    def partitions(self) -> list[InputPartition]:
        width, parts = layout(self.path)
        return [Range(p, width) for p in ranges(width, parts, self.most)] or [Range(Part(self.path, 0, 0, 0), width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, width = partition.part, partition.width
        step = max(1, (4 << 20) // max(1, 4 * width))
        for k in range(0, p.rows, step):
            n = min(step, p.rows - k)
            columns = {"row": pa.array(np.arange(p.first + k, p.first + k + n))}
            if "vector" in self.names:
                data = _read(p.path, p.start + 4 * width * k, 4 * width * n)
                if len(data) != 4 * width * n:
                    raise ContractError(f"{p.path} ended early")
                columns["vector"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.frombuffer(data, "<f4")))
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    task: int
    file: str
    rows: int
    width: int
    crc: int


class Float32Writer(DataSourceArrowWriter):
    """A file for each task; the manifest, written last, makes them a table."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, file = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.f32"
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        rows = crc = 0
        width = -1
        try:
            with system.open_output_stream(f"{at}/{file}") as f:
                for batch in batches:
                    v = batch.column("vector")
                    if v.null_count or v.values.null_count:
                        raise ContractError("a vector or component is null")
                    sizes = np.diff(v.offsets.to_numpy())
                    if not len(sizes):
                        continue
                    width = int(sizes[0]) if width < 0 else width
                    if (sizes != width).any():
                        raise ContractError(f"vectors of other widths than {width}")
                    data = v.flatten().to_numpy().astype("<f4")
                    if not np.isfinite(data).all():
                        raise ContractError("a component isn't finite")
                    f.write(data.tobytes())
                    rows, crc = rows + len(sizes), zlib.crc32(data.tobytes(), crc)
        except Exception:
            _forget(f"{self.path}/{file}")
            raise
        return Written(task, file, rows, width, crc)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task)
        if len({m.width for m in parts}) > 1:
            self.abort(messages)
            raise ContractError(f"vectors of widths {sorted({m.width for m in parts})}")
        system, at = _opened(self.path)
        body = {"width": parts[0].width if parts else 0, "parts": [{"file": m.file, "rows": m.rows, "crc": m.crc} for m in parts]}
        with system.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps(body).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                _forget(f"{self.path}/{m.file}")


class Float32Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "float32"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if not set(schema.names) <= {"row", "vector"}:
            raise ContractError(f"columns are row and vector, not {schema.names}")
        return Float32Reader(self.options["path"], schema.names, int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))

    def writer(self, schema: T.StructType, overwrite: bool) -> Float32Writer:
        if "vector" not in schema.names or overwrite:
            raise ContractError("writes a column named vector, to a new folder only")
        return Float32Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Float32Source)


def read_vectors(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, vectors: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("float32").option("rangeBytes", range_bytes).schema(SCHEMA if vectors else "row long").load(path)


def write_vectors(df: DataFrame, path: str, row: str, vector: str, partitions: int | None = None) -> None:
    """The vectors in the order of ``row``: ranges of it are the parts."""
    register(df.sparkSession)
    ordered = df.repartitionByRange(partitions, row) if partitions else df.repartitionByRange(row)
    ordered.sortWithinPartitions(row).select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vector")).write.format("float32").mode("append").save(path)


def verify_vectors(spark: SparkSession, path: str) -> int:
    """The rows of a folder whose parts all have the checksums of its manifest; each part is read by one task."""
    layout(path)
    system, at = _opened(path)
    with system.open_input_file(f"{at.rstrip('/')}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    if not parts:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, crc in zip(batch.column("file").to_pylist(), batch.column("crc").to_pylist()):
                own, files = 0, _opened(f"{path.rstrip('/')}/{file}")
                with files[0].open_input_stream(files[1]) as f:
                    while data := f.read(4 << 20):
                        own = zlib.crc32(data, own)
                if own != crc:
                    raise ContractError(f"{file} isn't what the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    rows = spark.createDataFrame([(p["file"], p["crc"]) for p in parts], "file string, crc long").repartition(len(parts))
    rows.mapInArrow(run, "file string").count()
    return sum(p["rows"] for p in parts)


def read_archive(spark: SparkSession, path: str, names: dict[str, str], cube: str) -> DataFrame:
    """Cells (file, *names.values(), value) of .npz archives: arrays of names for each axis, in order, and a cube of positive numbers.

    names: array -> column. Each archive must hold just these arrays, the cube with an axis for each list of
    distinct names, all values finite and positive; else an error. An archive is one task's.
    """
    keys, columns = list(names), list(names.values())
    schema = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(c, T.StringType()) for c in columns], T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as archive:
                    if set(archive.files) != {*keys, cube}:
                        raise ContractError(f"{file} holds {sorted(archive.files)}")
                    axes, values = [archive[k] for k in keys], archive[cube]
                if values.shape != tuple(len(a) for a in axes) or any(a.ndim != 1 or len(set(a.tolist())) != len(a) for a in axes):
                    raise ContractError(f"{file}: a cube of {values.shape} for axes of {[a.shape for a in axes]}, or names repeat")
                if not (np.isfinite(values) & (values > 0)).all():
                    raise ContractError(f"{file} holds values that aren't positive")
                flat = values.reshape(-1)
                for k in range(0, len(flat), 100_000):
                    at = np.unravel_index(np.arange(k, min(k + 100_000, len(flat))), values.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(at[0]), pa.string()), *[pa.array(a[i].astype(str)) for a, i in zip(axes, at)], pa.array(flat[k : k + 100_000].astype(float))], names=["file", *columns, "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def archive_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A .npz archive whose bytes depend on the arrays alone: sorted names, one date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(arrays):
            body = io.BytesIO()
            np.lib.format.write_array(body, arrays[name], allow_pickle=False)
            archive.writestr(zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0)), body.getvalue(), zipfile.ZIP_DEFLATED)
    return out.getvalue()
