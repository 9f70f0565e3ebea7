"""A Spark data source for folders of raw records: spark.read.format("records") and spark.readStream.format("records").

A folder has one level for the kind (profiles, posts, history), one for the platform and one for the handle, and in it files
of one JSON object a line: {"day": ..., "item": ...}, the day only for posts.  What the sources are asked for by handle and
date is so answered by listing and by reading lines: filters on platform and handle choose folders, a filter on day skips a
line before anything else is done with it.  The record itself stays text; sources.raw gives it types.

Where handles are many, folders of single ones are too: in place of handle=..., a folder handles=K-N holds all handles whose
CRC-32 is K modulo N, and its lines name theirs: {"handle": ..., "day": ..., "item": ...}.  A filter on handle still chooses
folders, then lines.  Both forms may stand side by side.

Spark 4.1 keeps one set of pushed filters for each load(): a frame of this format that one query filters in two ways gets
the second way's rows for both.  read() is the safe entry: its conditions reach the source, those put on its result don't,
and each call is a load of its own.

Options: path, kind; handles, the number of lowest folders that one partition reads (1 if not set); for
streams settle, the seconds for which a file must not have changed before it is read (1).

A stream's offset is the time of the newest file read.  Files are read whole and once, so they have to be moved into their
folder complete, as Spark's writers do.  Lines that aren't of the form above make a row with the whole line as its item,
which sources.raw then rejects: no line is lost.
"""

from __future__ import annotations

import io
import json
import time
import zlib
from collections.abc import Iterator, Sequence
from datetime import date, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from ..functions.scalar import evaluated

SCHEMAS = {
    "profiles": "platform string, handle string, item string",
    "posts": "platform string, handle string, day date, item string",
    "history": "platform string, handle string, item string",
}
ROWS = 2_000


def _store(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Folder(InputPartition):
    """Files of some handles: (platform, handle, path); handle is None where lines name it."""

    def __init__(self, files: Sequence[tuple[str, str | None, str]]):
        super().__init__(None)
        self.files = tuple(files)


class _Files:
    """What batch and stream readers share: listing, and reading lines."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "posts")
        self.per_partition, self.settle = int(options.get("handles", "1")), float(options.get("settle", "1"))
        self.since: date | None = None
        self.chosen: dict[str, set[str]] = {}

    def listed(self) -> list[tuple[int, str, str, str]]:
        """(time, platform, lowest folder, path) of the files of the folders that were asked for."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(f"{root}/kind={self.kind}", allow_not_found=True, recursive=True)):
            parts = info.path.rsplit("/", 3)
            if not info.is_file or info.base_name.startswith(("_", ".")) or not (parts[1].startswith("platform=") and parts[2].startswith(("handle=", "handles="))):
                continue
            platform = unquote(parts[1][9:])
            if platform in self.chosen.get("platform", {platform}) and self.may_hold(parts[2]):
                found.append((info.mtime_ns, platform, parts[2], info.path))
        return sorted(found)

    def may_hold(self, folder: str) -> bool:
        """Whether rows of the handles that were asked for may be in a lowest folder."""
        asked = self.chosen.get("handle")
        if asked is None:
            return True
        if folder.startswith("handle="):
            return unquote(folder[7:]) in asked
        own, number = map(int, folder[8:].split("-"))
        return any(h is not None and _bundle(h, number) == own for h in asked)

    def folders(self, files: list[tuple[int, str, str, str]]) -> list[_Folder]:
        own: dict[tuple[str, str], list] = {}
        for _, platform, folder, path in files:
            own.setdefault((platform, folder), []).append((platform, unquote(folder[7:]) if folder.startswith("handle=") else None, path))
        groups = [own[k] for k in sorted(own)]
        # Spark wants one partition at least
        return [_Folder(sum(groups[i : i + self.per_partition], [])) for i in range(0, max(1, len(groups)), self.per_partition)]

    def lines(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        dated = self.kind == "posts"
        types = [pa.string(), pa.string(), *([pa.date32()] if dated else []), pa.string()]
        names = ["platform", "handle", *(["day"] if dated else []), "item"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        asked = self.chosen.get("handle")
        for platform, folder, path in partition.files:
            with store.open_input_stream(path) as stream:
                for line in io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"):
                    line = line.rstrip("\r\n")
                    if not line:
                        continue
                    day, item, named = _split(line)
                    handle = named if folder is None else folder
                    if asked is not None and handle not in asked:
                        continue
                    if self.since is not None and (day is None or day < self.since):
                        continue
                    rows.append((platform, handle, day, item) if dated else (platform, handle, item))
                    if len(rows) == ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


def _bundle(handle: str, number: int) -> int:
    return zlib.crc32(handle.encode("utf-8", "surrogatepass")) % number


def _split(line: str) -> tuple[date | None, str | None, str | None]:
    """Day, item and handle of a line."""
    try:
        entry = json.loads(line)
        item = entry["item"]
    except (ValueError, KeyError, TypeError):
        return None, line, None
    try:
        day = date.fromisoformat(str(entry.get("day"))[:10])
    except ValueError:
        day = None
    named = entry.get("handle")
    return day, item if item is None or isinstance(item, str) else json.dumps(item, ensure_ascii=False), named if named is None else str(named)


class _Reader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality on platform and handle, and a lower bound on day; gives back what it doesn't answer."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("platform", "handle") and isinstance(f, (EqualTo, In)):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.chosen[name] = self.chosen.get(name, values) & values
            elif name == "day" and self.kind == "posts" and isinstance(f, GreaterThanOrEqual) and type(f.value) is date:
                self.since = max(self.since or f.value, f.value)
            elif name == "day" and self.kind == "posts" and isinstance(f, GreaterThan) and type(f.value) is date:
                self.since = max(self.since or f.value, f.value)  # the day itself is tested again
                yield f
            else:
                yield f

    def partitions(self) -> list[_Folder]:
        return self.folders(self.listed())

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        return self.lines(partition)


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        now = (time.time() - self.settle) * 1e9
        return {"until": max([t for t, *_ in self.listed() if t <= now], default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        return self.folders([f for f in self.listed() if start["until"] < f[0] <= end["until"]])

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        return self.lines(partition)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "posts")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let its filters reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)


def read(spark: SparkSession, path: str, kind: str = "posts", since=None, platform: str | None = None, handles: Sequence[str] = (), per_partition: int = 1) -> DataFrame:
    """Rows of a folder of records, from the day `since` on, of one platform and of these handles, where given."""
    register(spark)
    rows = spark.read.format("records").options(path=path, kind=kind, handles=per_partition).load()
    if since is not None:
        rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
    if platform is not None:
        rows = rows.where(F.col("platform") == platform)
    if handles:
        rows = rows.where(F.col("handle").isin(*handles))
    return rows.withColumn("item", evaluated(F.col("item")))


def write(rows: DataFrame, path: str, kind: str, bundles: int | None = None) -> None:
    """Append rows (platform, handle, item, for posts day) to a folder of records, one file a handle and task; with bundles,
    one file for each of so many sets of handles."""
    own = [c for c in (*(["handle"] if bundles else []), "day", "item") if c in rows.columns]
    line = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in own]), {"ignoreNullFields": "false"}).alias("value")
    handle = F.col("handle").cast("string")
    folder = F.concat_ws("-", F.coalesce(F.crc32(handle) % bundles, F.lit(0)).cast("string"), F.lit(str(bundles))).alias("handles") if bundles else handle.alias("handle")
    lowest = "handles" if bundles else "handle"
    rows.select("platform", folder, line).repartition("platform", lowest).write.mode("append").partitionBy("platform", lowest).text(f"{path.rstrip('/')}/kind={kind}")
