"""Windows as shards of `.npy` files, written and read as a Python data source.

    arrays.register(spark)
    windows.write.format("npy").mode("append").save("file:///shared/windows")
    spark.read.format("npy").schema("image_id string, data array<double>").option("shape", "40x40x3").load(...)

Rows need an array column `data` of height * width * n_channels numbers and the
three sizes; all other columns are kept.  Every shape has its own folder
(`40x40x3`), so that reading one shape lists no other.  A shard is one `.npy` of
shape (rows, height, width, n_channels) and a Parquet file of the other columns
in the same order.  A task writes into `_making/<job>`; its files get their
places when the job is committed, and are deleted when it is aborted, so killed
attempts leave nothing that a reader sees.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SIZES = ("height", "width", "n_channels")
SHAPE = re.compile(r"(\d+)x(\d+)x(\d+)")
#: Bytes of numbers in a shard, at most (but for a single larger window).
SHARD_BYTES = 64 << 20


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Shard(InputPartition):
    stem: str
    shape: tuple[int, int, int]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # of a shape, and a file's name


class ArrayFiles(DataSource):
    """The format `npy`; options path, shape to read one shape, shard_bytes to write."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        raise ValueError("give the columns to read by .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in ("data", *SIZES) if c not in schema.names]
        if missing:
            raise ValueError(f"no columns {missing}")
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.shape, self.schema = options["path"].rstrip("/"), options.get("shape"), schema

    def partitions(self) -> list[Shard]:
        files, root = _open(self.path)
        if self.shape:
            folders = [f"{root}/{self.shape}"]
        else:
            folders = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and SHAPE.fullmatch(f.base_name)]
        found = []
        for folder in sorted(folders):
            shape = SHAPE.fullmatch(folder.rsplit("/", 1)[1])
            if shape is None:
                raise ValueError(f"not a shape: {self.shape}")
            names = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            found += [Shard(f.path.removesuffix(".npy"), tuple(map(int, shape.groups()))) for f in sorted(names, key=lambda f: f.path) if f.extension == "npy"]
        return found

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Shard):  # no shard at all
            return
        files, _ = _open(self.path)
        wanted = to_arrow_schema(self.schema)
        with files.open_input_file(f"{partition.stem}.parquet") as f:
            others = pq.read_table(f, columns=[c for c in wanted.names if c not in ("data", *SIZES)])
        n = others.num_rows
        columns = {k: pa.array(np.full(n, v)) for k, v in zip(SIZES, partition.shape, strict=True)}
        if "data" in wanted.names:
            with files.open_input_stream(f"{partition.stem}.npy") as f:
                values = np.load(io.BytesIO(f.read()), allow_pickle=False)
            n = len(values)
            each = int(np.prod(values.shape[1:]))
            columns["data"] = pa.LargeListArray.from_arrays(np.arange(n + 1, dtype=np.int64) * each, values.reshape(-1))
            columns |= {k: pa.array(np.full(n, v)) for k, v in zip(SIZES, partition.shape, strict=True)}
        arrays = [(columns[c] if c in columns else others.column(c)).cast(t) for c, t in zip(wanted.names, wanted.types, strict=True)]
        yield from pa.table(arrays, schema=wanted).to_batches()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.shard_bytes = int(options.get("shard_bytes", SHARD_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        made, held = [], {}

        def flush(shape: tuple) -> None:
            rows = pa.concat_tables(held.pop(shape)[1])
            folder, name = "x".join(map(str, shape)), f"part-{uuid.uuid4().hex}"
            making = f"{root}/_making/{self.job}/{folder}"
            files.create_dir(making)
            data = rows.column("data").combine_chunks()
            values = data.flatten().to_numpy(zero_copy_only=False)
            if data.null_count or len(values) != len(rows) * int(np.prod(shape)):
                raise ValueError(f"a window's data is not of its shape {folder}")
            with files.open_output_stream(f"{making}/{name}.npy") as f:
                buffer = io.BytesIO()
                np.save(buffer, values.reshape(len(rows), *shape))
                f.write(buffer.getbuffer())
            with files.open_output_stream(f"{making}/{name}.parquet") as f:
                pq.write_table(rows.drop_columns(["data", *SIZES]), f)
            made.append((folder, name))

        for batch in batches:
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SIZES], 1)
            if not np.isfinite(sizes.astype(float)).all():
                raise ValueError("a window without its sizes")
            for shape in map(tuple, np.unique(sizes, axis=0).astype(int).tolist()):
                rows = pa.table(batch.filter(pa.array((sizes == shape).all(1))))
                width = max(8 * int(np.prod(shape)), 1)
                step = max(self.shard_bytes // width, 1)
                while len(rows):
                    size, parts = held.setdefault(shape, (0, []))
                    take = min(len(rows), max(step - size, 1))
                    parts.append(rows.slice(0, take))
                    held[shape], rows = (size + take, parts), rows.slice(take)
                    if size + take >= step:
                        flush(shape)
            while sum(n * 8 * int(np.prod(s)) for s, (n, _) in held.items()) > 2 * self.shard_bytes:  # many shapes at once
                flush(max(held, key=lambda s: held[s][0] * int(np.prod(s))))
        for shape in list(held):
            flush(shape)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.Directory and SHAPE.fullmatch(f.base_name):
                    files.delete_dir(f.path)
        for folder, name in (x for m in messages if m for x in m.files):
            files.create_dir(f"{root}/{folder}")
            for end in ("parquet", "npy"):  # readers look for .npy, which comes last
                files.move(f"{root}/_making/{self.job}/{folder}/{name}.{end}", f"{root}/{folder}/{name}.{end}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        making = f"{root}/_making"
        if files.get_file_info(f"{making}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{making}/{self.job}")
        if files.get_file_info(making).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(making)):
            files.delete_dir(making)
