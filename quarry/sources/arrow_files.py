"""Arrow IPC files as a data source: ``spark.read.format("arrow_ipc").load(path)``.

A file of the random-access format is read in partitions of whole record batches, found in its footer; one of the stream format, which has no footer, is one
partition (dataset writers cut their streams into shards of some hundred megabytes). Batches go to Spark as they are, without a Python row between.

Options: ``columns``, comma-separated, reads only these fields; ``position`` names a column for a number that follows files, batches and rows;
``partitionBytes`` is what a partition's batches have on average.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

from quarry.sources.files import opened

MAGIC = b"ARROW1"
PARTITION_BYTES = 64 << 20
#: Bits of a position for the place in a batch, and the batch in a file.
ROW_BITS, BATCH_BITS = 24, 20


def files_of(path: str) -> list[str]:
    """The data files of ``path``, in order: those that the ``state.json`` of a stored dataset lists, else all ``.arrow`` files by name.

    A folder of shards that has been worked with also holds cached results, which the list leaves out.
    """
    system, root = opened(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [path]
    state = f"{root.rstrip('/')}/state.json"
    if system.get_file_info(state).type == fs.FileType.File:
        with system.open_input_file(state) as handle:
            names = [f["filename"] for f in json.loads(handle.read())["_data_files"]]
    else:
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(".arrow"))
    if not names:
        raise FileNotFoundError(f"{path} has no Arrow files")
    is_address = path.startswith("file:") or "://" in path
    return [f"{path.rstrip('/')}/{quote(n) if is_address else n}" for n in names]


def _is_random_access(handle) -> bool:
    found = handle.read(len(MAGIC)) == MAGIC
    handle.seek(0)
    return found


def _schema(uri: str) -> pa.Schema:
    system, path = opened(uri)
    with system.open_input_file(path) as handle:
        return (ipc.open_file if _is_random_access(handle) else ipc.open_stream)(handle).schema


@dataclass
class Batches(InputPartition):
    """Batches ``first`` to ``end`` (``None``: all of a stream) of a file."""

    uri: str
    number: int
    first: int
    end: int | None


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None, position: str | None, schema: StructType | None, partition_bytes: int = PARTITION_BYTES):
        self.path, self.columns, self.position, self.schema, self.partition_bytes = path, columns, position, schema, partition_bytes

    def partitions(self) -> list[InputPartition]:
        out = []
        for number, uri in enumerate(files_of(self.path)):
            system, path = opened(uri)
            with system.open_input_file(path) as handle:
                if not _is_random_access(handle):
                    out.append(Batches(uri, number, 0, None))
                    continue
                n = ipc.open_file(handle).num_record_batches
                step = max(1, n * self.partition_bytes // max(1, handle.size()))
                out += [Batches(uri, number, at, min(n, at + step)) for at in range(0, n, step)]
        return out

    def read(self, partition: Batches):
        system, path = opened(partition.uri)
        with system.open_input_file(path) as handle:
            if partition.end is None:
                with ipc.open_stream(handle) as stream:
                    for number, batch in enumerate(stream):
                        yield self._given(batch, partition, number)
            else:
                names = ipc.open_file(handle).schema.names
                wanted = None if self.columns is None else [names.index(c) for c in self.columns if c in names]
                source = ipc.open_file(handle, options=ipc.IpcReadOptions(included_fields=wanted))
                for number in range(partition.first, partition.end):
                    yield self._given(source.get_batch(number), partition, number)

    def _given(self, batch: pa.RecordBatch, partition: Batches, number: int) -> pa.RecordBatch:
        names = [f.name for f in self.schema if f.name != self.position]
        if missing := sorted(set(names) - set(batch.schema.names)):
            raise ValueError(f"{partition.uri} lacks {missing}")
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        if self.position:
            if batch.num_rows >> ROW_BITS or number >> BATCH_BITS:
                raise ValueError(f"{partition.uri} has too large or too many batches to number their rows")
            begin = ((partition.number << BATCH_BITS) + number) << ROW_BITS
            columns.append(pa.array(range(begin, begin + batch.num_rows), pa.int64()))
            names = [*names, self.position]
        return pa.RecordBatch.from_arrays(columns, names)


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _columns(self) -> list[str] | None:
        given = self.options.get("columns")
        return None if given is None else [c.strip() for c in given.split(",")]

    def schema(self) -> StructType:
        """The first file's fields, or the wanted ones in the order asked for; a wanted one that it lacks raises."""
        found, wanted = _schema(files_of(self.options["path"])[0]), self._columns()
        if wanted is not None:
            if missing := sorted(set(wanted) - set(found.names)):
                raise ValueError(f"the Arrow files lack {missing}")
            found = pa.schema([found.field(c) for c in wanted])
        kind = from_arrow_schema(found)
        return kind.add(self.options["position"], LongType()) if "position" in self.options else kind

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], self._columns(), self.options.get("position"), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)
