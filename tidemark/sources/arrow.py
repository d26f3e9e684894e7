"""Arrow IPC files: a data source with a partition for each record batch, and a writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path; executors reach local ones through a shared mount."""
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    fs, root = filesystem(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(root))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".arrow"))


@dataclass
class _Batch(InputPartition):
    file: str
    number: int


class ArrowReader(DataSourceReader):
    """Reads the batches' named columns only, and rows that pass the filters that Spark hands over."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.names, self.tests = path, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value are done here; the others are Spark's."""
        for f in filters:
            if type(f) in (*_TESTS, In, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[_Batch]:
        """Of each file only the footer is read."""
        out = []
        for file in _files(self.path):
            fs, at = filesystem(file)
            with fs.open_input_file(at) as source:
                out += [_Batch(file, i) for i in range(pa.ipc.open_file(source).num_record_batches)]
        return out

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a batch
            return
        fs, at = filesystem(partition.file)
        with fs.open_input_file(at) as source:
            own = pa.ipc.open_file(source).schema
            needed = sorted({own.get_field_index(n) for n in self.names})
            batch = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=needed)).get_batch(partition.number).select(self.names)
            for f in self.tests:
                values = batch.column(f.attribute[0])
                if isinstance(f, IsNotNull):
                    keep = pc.is_valid(values)
                elif isinstance(f, In):
                    keep = pc.is_in(values, pa.array(list(f.value), values.type))
                else:
                    keep = _TESTS[type(f)](values, pa.scalar(f.value, values.type))
                batch = batch.filter(keep)  # a NULL passes no test
            yield batch


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").option("columns", "a,b").load(path)``: a file, or the ``.arrow`` files of a folder.

    Without ``columns`` all are read. Spark's Python sources aren't told which columns a query needs, so pruning is by that option or by
    ``read_arrow(columns=...)``; filters are handed over where ``spark.sql.python.filterPushdown.enabled`` is on.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        fs, at = filesystem(files[0])
        with fs.open_input_file(at) as source:
            found = from_arrow_schema(pa.ipc.open_file(source).schema)
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        missing = [c for c in wanted if c not in found.names]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return T.StructType([found[c] for c in wanted]) if wanted else found

    def reader(self, schema: T.StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema)


def read_arrow(spark: SparkSession, path: str, *, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("arrow_files")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_arrow(df: DataFrame, path: str, *, compression: str | None = "zstd") -> int:
    """A file for each partition with rows, a record batch for each batch that Spark sends; gives the number of rows.

    A task writes under a name of its own attempt; what attempts that failed or were doubled left is deleted at the end, so rows are there
    once. ``path`` must be new or empty, and reached by all executors.
    """
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    if _files(path):
        raise ValueError(f"{path} has Arrow files already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = writer = None
        name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow", 0
        for batch in batches:
            if writer is None:
                own, at = filesystem(path)
                sink = own.open_output_stream(f"{at}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression))
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["name", "rows"])

    told = df.mapInArrow(run, "name string, rows long").collect()
    kept = {r["name"] for r in told}
    for file in _files(path):
        if file.rsplit("/", 1)[-1] not in kept:
            own, at = filesystem(file)
            own.delete_file(at)
    return sum(r["rows"] for r in told)
