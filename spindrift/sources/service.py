"""A record service as a Spark source and sink: pushed filters, streams by offset, writes that count once.

A service keeps its records in pages (Parquet files) in a folder that all
executors see, through any file system that Arrow opens. A write stages a file a
task and then adds one numbered entry to the service's log, which names the
files of the tasks that counted, with the extremes of their columns; so a task
that runs twice, or a job that fails, leaves nothing that a reader sees. An
entry is made once: of two writers that want the same number one tries the next.
The number is the offset of streams.

Readers prune pages by the extremes and filter rows themselves; what they can't
decide Spark filters again.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "record_service"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(root: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(root if ":" in root else f"file://{root}")


def put_once(root: str, name: str, data: bytes) -> bool:
    """Writes a file that doesn't exist; False where it does. Of several writers at once one succeeds: a local file is made
    exclusively, other file systems refuse to move one over another."""
    fs, path = opened(root)
    fs.create_dir(path, recursive=True)
    staged = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(staged) as out:
        out.write(data)
    try:
        if isinstance(fs, pf.LocalFileSystem):
            os.link(staged, f"{path}/{name}")
        else:
            fs.move(staged, f"{path}/{name}")
            return True
    except OSError:
        return False
    finally:
        if fs.get_file_info(staged).type != pf.FileType.NotFound:
            fs.delete_file(staged)
    return True


def entries(root: str, after: int = -1, to: int | None = None) -> list[dict]:
    """Log entries with numbers after one and up to another, in order."""
    fs, path = opened(root)
    found = fs.get_file_info(pf.FileSelector(f"{path}/log", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name[0] != ".")
    out = []
    for name in names:
        if after < int(name) and (to is None or int(name) <= to):
            with fs.open_input_stream(f"{path}/log/{name}") as data:
                out.append({"number": int(name), **json.loads(data.read())})
    return out


def latest(root: str) -> int:
    return max((e["number"] for e in entries(root)), default=-1)


def logged(root: str, files: list[dict], keep: bool = True, tag: str | None = None) -> int:
    """Adds an entry; keep: what was there before still counts. tag: an entry with it is added once, whoever tries again."""
    while True:
        known = entries(root)
        for e in known:
            if tag is not None and e["tag"] == tag:
                return e["number"]
        number = max((e["number"] for e in known), default=-1) + 1
        if put_once(f"{root}/log", f"{number:012d}", json.dumps({"files": files, "keep": keep, "tag": tag}).encode()):
            return number


def current(found: list[dict]) -> list[dict]:
    """The files that count after some entries."""
    files: list[dict] = []
    for e in found:
        files = (files if e["keep"] else []) + e["files"]
    return files


def extremes(table: pa.Table) -> dict:
    """column -> (least, greatest, number of nulls) of columns that JSON can hold."""
    out = {}
    for name in table.column_names:
        kind = table.schema.field(name).type
        if len(table) and (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_floating(kind)):
            low = pc.min_max(table.column(name)).as_py()
            if not any(isinstance(v, float) and v != v for v in low.values()):
                out[name] = [low["min"], low["max"], table.column(name).null_count]
    return out


TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def supported(f) -> bool:
    return len(f.attribute) == 1 and (type(f) in (*TESTS, In, IsNull, IsNotNull)) and all(isinstance(v, (int, str, bool)) for v in ([*f.value] if isinstance(f, In) else [f.value] if hasattr(f, "value") else []))


def may_hold(f, stats: dict) -> bool:
    """Whether a page with these extremes can hold rows that pass."""
    name = f.attribute[0]
    if name not in stats:
        return True
    low, high, nulls = stats[name]
    if isinstance(f, IsNull):
        return nulls > 0
    if low is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value)
    return {EqualTo: low <= f.value <= high, GreaterThan: high > f.value, GreaterThanOrEqual: high >= f.value, LessThan: low < f.value, LessThanOrEqual: low <= f.value}[type(f)]


def passing(batch: pa.RecordBatch, filters: list) -> pa.RecordBatch:
    for f in filters:
        column = batch.column(f.attribute[0])
        if isinstance(f, IsNull):
            ok = pc.is_null(column)
        elif isinstance(f, IsNotNull):
            ok = pc.is_valid(column)
        elif isinstance(f, In):
            ok = pc.is_in(column, value_set=pa.array(list(f.value), column.type))
        else:
            ok = TESTS[type(f)](column, pa.scalar(f.value, column.type))
        batch = batch.filter(ok)
    return batch


def page_rows(root: str, name: str, columns: list[str], filters: list):
    fs, path = opened(root)
    with pq.ParquetFile(fs.open_input_file(f"{path}/{name}")) as file:
        for batch in file.iter_batches(batch_size=10_000, columns=columns):
            yield passing(batch, filters)


class Page(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns, self.filters = root, columns, []

    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        files = current(entries(self.root))
        kept = [f["name"] for f in files if all(may_hold(x, f["extremes"]) for x in self.filters)]
        return [Page(n) for n in kept] or [Page(None)]

    def read(self, partition):
        if partition.value is not None:
            yield from page_rows(self.root, partition.value, self.columns, self.filters)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def initialOffset(self):
        return {"number": -1}

    def latestOffset(self):
        return {"number": latest(self.root)}

    def partitions(self, start, end):
        found = entries(self.root, start["number"], end["number"])
        return [Page(f["name"]) for e in found for f in e["files"]] or [Page(None)]

    def read(self, partition):
        if partition.value is not None:
            yield from page_rows(self.root, partition.value, self.columns, [])


class Staged(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


def staged(root: str, batches) -> Staged:
    """Writes a task's rows as a page of its own name: a task that runs again writes another one."""
    fs, path = opened(root)
    table = None
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return Staged([])
    table = pa.Table.from_batches(batches)
    context = TaskContext.get()
    name = f"pages/{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.parquet"
    fs.create_dir(f"{path}/pages", recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as out:
        pq.write_table(table, out, compression="zstd")
    return Staged([{"name": name, "rows": len(table), "extremes": extremes(table)}])


def dropped(root: str, messages) -> None:
    fs, path = opened(root)
    for m in messages:
        for f in m.files if m else []:
            if fs.get_file_info(f"{path}/{f['name']}").type == pf.FileType.File:
                fs.delete_file(f"{path}/{f['name']}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool, tag: str | None):
        self.root, self.overwrite, self.tag = root, overwrite, tag

    def write(self, iterator):
        return staged(self.root, iterator)

    def commit(self, messages):
        logged(self.root, [f for m in messages if m for f in m.files], keep=not self.overwrite, tag=self.tag)

    def abort(self, messages):
        dropped(self.root, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    """A batch's entry has its number as tag: a batch that is written again after a restart counts once."""

    def __init__(self, root: str, tag: str):
        self.root, self.tag = root, tag

    def write(self, iterator):
        return staged(self.root, iterator)

    def commit(self, messages, batchId):
        logged(self.root, [f for m in messages if m for f in m.files], tag=f"{self.tag}/{batchId}")

    def abort(self, messages, batchId):
        dropped(self.root, messages)


class RecordService(DataSource):
    """Options: path (the service's folder), columns (their schema; needed to read), tag (an entry with it is added once)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return _Reader(self.options["path"], schema.names)

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite, self.options.get("tag"))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"], self.options.get("tag", "stream"))


def registered(spark: SparkSession) -> str:
    """The source's name, once it is known to the session and filters are pushed to it."""
    spark.dataSource.register(RecordService)
    spark.conf.set(PUSHDOWN, "true")
    return NAME


def claim(root: str, choices: list[str], worker: str, tries: int = 8) -> str | None:
    """The first of some choices that nobody else has claimed, for a worker: a claim is a file that can be made once; who comes
    late tries the next choice, so many times at most."""
    for choice in choices[:tries]:
        if put_once(f"{root}/claims", choice, worker.encode()):
            return choice
    return None


def claims(root: str) -> dict[str, str]:
    """choice -> worker."""
    fs, path = opened(root)
    found = [f for f in fs.get_file_info(pf.FileSelector(f"{path}/claims", allow_not_found=True)) if f.base_name[0] != "."]
    return {f.base_name: fs.open_input_stream(f.path).read().decode() for f in found}
