"""Run events and saved results as data sources of Spark: format("tidewell_events") and format("tidewell_saved").

An event log is a folder partition=<p>/<ms>-<seq>.jsonl: a file is named by its first event's id and
appears whole; ids (<ms>-<seq>) rise along a partition. Each line is {"id", "run_id", "event", "data"};
lines that can't be read, or have no id, are passed over. As a stream, the offset is each partition's
last id, so a restart goes on after the last event that was delivered. Read in one go, a filter on
run_id or partition, or a run's range of ids, is applied while reading, and files outside the ids aren't opened.

Saved results are files of JSON lines, <kind>/<name>.json or kind=<kind>/name=<name>/part-...; kind and
name are columns, and a filter on them decides which files are opened.

Files are found through pyarrow's file systems, so a path may have any scheme that these know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidewell.sources.messages import split_id

EVENT = "partition INT, id STRING, ms LONG, seq LONG, run_id STRING, event STRING, data STRING"
SAVED = "kind STRING, name STRING, line_no LONG, line STRING"
BEGIN = "0-0"
#: Of a newest file's end, so many bytes are looked at for its last id, then twice as many, ...
TAIL = 1 << 16

Id = tuple[int, int]


def place(event_id: str | None) -> Id | None:
    """(ms, seq) of <ms>-<seq>, or nothing."""
    ms, dash, seq = (event_id or "").partition("-") if isinstance(event_id, str) else ("", "", "")
    return (int(ms), int(seq)) if dash and ms.isascii() and seq.isascii() and ms.isdigit() and seq.isdigit() else None


def read_line(line: bytes) -> tuple | None:
    """(id, ms, seq, run_id, event, data) of a line of the log, or nothing if it is malformed."""
    try:
        x = json.loads(line)
    except ValueError:
        return None
    at = place(x.get("id")) if isinstance(x, dict) else None
    if at is None or not isinstance(x.get("run_id"), str) or not isinstance(x.get("event"), str):
        return None
    data = x.get("data")
    return x["id"], *at, x["run_id"], x["event"], data if isinstance(data, str) or data is None else json.dumps(data)


def write_events(events: DataFrame, path: str) -> None:
    """Write events (partition, id, run_id, event, data) as new files of the log, one for each partition, in the order of their ids.

    Spark writes a partition's lines in order; the file is renamed to its first id.
    """
    spark = events.sparkSession
    at = split_id(F.col("id"))
    line = F.to_json(F.struct("id", "run_id", "event", "data"))
    staged = f"{path.rstrip('/')}/_staged"
    first = events.groupBy("partition").agg(F.min(at).alias("first"))
    parts = [(r["partition"], r["first"]) for r in first.collect()]
    events.select("partition", at.alias("at"), line.alias("value")).repartition("partition").sortWithinPartitions("partition", "at").select("partition", "value").write.mode("overwrite").partitionBy("partition").text(staged)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for partition, start in parts:
        source = next(x.getPath() for x in fs.listStatus(jvm.Path(f"{staged}/partition={partition}")) if x.getPath().getName().startswith("part-"))
        folder = jvm.Path(f"{path}/partition={partition}")
        fs.mkdirs(folder)
        fs.rename(source, jvm.Path(folder, f"{start['ms']}-{start['seq']}.jsonl"))
    fs.delete(jvm.Path(staged), True)


class Files:
    """The files of a log, by partition, with the id that each begins with."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def by_partition(self) -> dict[int, list[tuple[Id, str]]]:
        out: dict[int, list[tuple[Id, str]]] = {}
        for x in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            folder, _, name = x.path.rpartition("/")
            at = place(name.removesuffix(".jsonl")) if name.endswith(".jsonl") else None
            if at is not None and "/_" not in x.path and (p := folder.rpartition("partition=")[2]).isdigit():
                out.setdefault(int(p), []).append((at, x.path))
        return {p: sorted(found) for p, found in out.items()}

    def last_id(self, path: str) -> str | None:
        """The id of the last readable line."""
        with self.fs.open_input_file(path) as f:
            size, n = f.size(), TAIL
            while True:
                data = f.read_at(min(n, size), max(0, size - n))
                lines = data.split(b"\n")[0 if n >= size else 1 :]
                found = next((x[0] for line in reversed(lines) if (x := read_line(line))), None)
                if found or n >= size:
                    return found
                n *= 2

    def lines(self, path: str) -> Iterator[bytes]:
        with self.fs.open_input_stream(path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from whole
            if rest:
                yield rest

    def between(self, partition: int, files: list[tuple[Id, str]], after: Id, upto: Id | None) -> list[Slice]:
        """The files of a partition that may hold ids after the one and up to the other."""
        nexts = [at for at, _ in files[1:]] + [None]
        return [Slice(partition, path, after, upto) for (at, path), later in zip(files, nexts) if (later is None or later > (after[0], after[1] + 1)) and (upto is None or at <= upto)]


class Slice(InputPartition):
    """A file of the log, and which of its ids are wanted: after < id <= upto."""

    def __init__(self, partition: int, path: str, after: Id, upto: Id | None):
        self.partition, self.path, self.after, self.upto = partition, path, after, upto


class _Log:
    def __init__(self, options):
        self.path, self.run_id, self.first = options["path"], options.get("run_id"), options.get("after", BEGIN)
        if place(self.first) is None:
            raise ValueError(f"after must be an event id, got {self.first!r}")
        self.runs: list[str] | None = [self.run_id] if self.run_id else None

    def read(self, part: Slice) -> Iterator[tuple]:
        for line in Files(self.path).lines(part.path):
            x = read_line(line)
            if x and part.after < (x[1], x[2]) and (part.upto is None or (x[1], x[2]) <= part.upto) and (self.runs is None or x[3] in self.runs):
                yield part.partition, *x


class EventReader(_Log, DataSourceReader):
    """One pass; equality and In on run_id and partition, and ranges of ms, are pushed down."""

    def __init__(self, options):
        _Log.__init__(self, options)
        self.partitions_wanted: set[int] | None = None
        self.low, self.high = place(self.first), None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in ("run_id", "partition") and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                if column == "run_id":
                    self.runs = [x for x in wanted if self.runs is None or x in self.runs]
                else:
                    self.partitions_wanted = set(wanted) if self.partitions_wanted is None else self.partitions_wanted & set(wanted)
                continue
            if column == "ms" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, (f.value + isinstance(f, GreaterThan), -1))
                continue
            if column == "ms" and isinstance(f, (LessThan, LessThanOrEqual)):
                high = (f.value - isinstance(f, LessThan), 1 << 62)
                self.high = high if self.high is None else min(self.high, high)
                continue
            yield f

    def partitions(self) -> list[Slice]:
        files = Files(self.path)
        return [s for p, found in files.by_partition().items() if self.partitions_wanted is None or p in self.partitions_wanted for s in files.between(p, found, self.low, self.high)]


class EventStream(_Log, DataSourceStreamReader):
    """Offsets: {partition: last id}. A partition that appears later is read from `after` on."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = Files(self.path)
        out = {}
        for p, found in files.by_partition().items():
            last = next((x for _, path in reversed(found) if (x := files.last_id(path))), None)
            if last:
                out[str(p)] = last
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        files = Files(self.path)
        found = files.by_partition()
        out = []
        for p, last in end.items():
            after, upto = max(place(start.get(p, BEGIN)), place(self.first)), place(last)
            if after < upto:
                out += files.between(int(p), found.get(int(p), []), after, upto)
        return out


class Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewell_events"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> EventReader:
        return EventReader(self.options)

    def streamReader(self, schema) -> EventStream:
        return EventStream(self.options)


class Document(InputPartition):
    def __init__(self, kind: str, name: str, path: str):
        self.kind, self.name, self.path = kind, name, path


class SavedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.wanted = options["path"], {"kind": None, "name": None}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in self.wanted and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = own if self.wanted[column] is None else self.wanted[column] & own
            else:
                yield f

    def partitions(self) -> list[Document]:
        files = Files(self.path)
        out = []
        for x in files.fs.get_file_info(pafs.FileSelector(files.root, recursive=True, allow_not_found=True)):
            *_, above, folder, name = ("", "", *x.path.split("/"))
            named = folder.startswith("name=") and above.startswith("kind=") and name.startswith("part-")
            own = {"kind": unquote(above[5:]), "name": unquote(folder[5:])} if named else {"kind": folder, "name": name.removesuffix(".json")}
            if x.is_file and name[0] not in "._" and (named or name.endswith(".json")) and all(v is None or own[c] in v for c, v in self.wanted.items()):
                out.append(Document(own["kind"], own["name"], x.path))
        return out

    def read(self, part: Document) -> Iterator[tuple]:
        for n, line in enumerate(Files(self.path).lines(part.path)):
            if line.strip():
                yield part.kind, part.name, n, line.decode("utf-8", "replace")


class Saved(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewell_saved"

    def schema(self) -> str:
        return SAVED

    def reader(self, schema) -> SavedReader:
        return SavedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Events)
    spark.dataSource.register(Saved)


def events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log so far. options: run_id, after (an event id)."""
    register(spark)
    return spark.read.format("tidewell_events").options(path=path, **options).load()


def follow(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log as a stream: what is there, then what arrives."""
    register(spark)
    return spark.readStream.format("tidewell_events").options(path=path, **options).load()


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("tidewell_saved").option("path", path).load()
