"""A log of offsets as files, and a Spark data source that reads it: batches of exactly the offsets that are asked for, and streams.

A log is a folder `partition=<n>/segment=<first offset>/` of text files with an object a line: offset, and value in base64. Every partition's offsets run without a gap, from 0 on
unless a start is given. A segment is read at once, sorted, and cut to the range that is asked for; a task reads segments in a row, one after the other; offsets that are missing, repeated, or not there yet are an
error, never fewer rows. Ends are fixed when a batch is planned.

    spark.dataSource.register(log_source())
    spark.read.format("offset_log").option("endingOffsets", '{"0": 500}').load(path)
    spark.readStream.format("offset_log").load(path)

Options: startingOffsets and endingOffsets, JSON by partition. Without a start a log whose first segment isn't at 0 is refused: its beginning was lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "partition int, offset long, value binary"
#: Offsets of a segment; tasks of a read up to which each segment is its own.
SEGMENT, TASKS = 10_000, 256


def write_segments(rows: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Appends rows (partition, offset, value) to a log. A segment's rows meet in one task: `segment` of them at most."""
    line = F.to_json(F.struct("offset", F.base64("value").alias("value")))
    placed = rows.select("partition", (F.floor(F.col("offset") / segment) * segment).alias("segment"), "offset", line.alias("line"))
    placed.repartition("partition", "segment").select("partition", "segment", F.col("line").alias("value")).write.mode("append").partitionBy("partition", "segment").text(path)


def log_source() -> type:
    """The data source's class. It is made in a function so that executors get it whole, wherever the library is installed."""
    tasks_at_most = TASKS
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    class Log:
        """What both readers share: the segments of a folder, and ranges of offsets as tasks."""

        def __init__(self, options: dict):
            import json

            self.path = options["path"]
            self.start = {int(k): v for k, v in json.loads(options["startingoffsets"]).items()} if "startingoffsets" in options else None
            self.end = {int(k): v for k, v in json.loads(options["endingoffsets"]).items()} if "endingoffsets" in options else None

        def store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

        def segments(self) -> dict[int, dict[int, list[str]]]:
            """Files by partition and first offset."""
            import re

            from pyarrow import fs

            store, root = self.store()
            found: dict[int, dict[int, list[str]]] = {}
            for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
                place = re.search(r"/partition=(\d+)/segment=(\d+)/(?![_.])[^/]+$", info.path)
                if place and info.size:
                    found.setdefault(int(place[1]), {}).setdefault(int(place[2]), []).append(info.path)
            return found

        def rows(self, files: list[str]) -> list[tuple[int, str | None]]:
            import json

            store, _ = self.store()
            out = []
            for name in files:
                with store.open_input_stream(name) as stream:
                    out += [(r["offset"], r.get("value")) for r in map(json.loads, stream.read().decode().splitlines())]
            return sorted(out, key=lambda r: r[0])

        def starts(self, found: dict[int, dict[int, list[str]]]) -> dict[int, int]:
            first = {n: min(own) for n, own in found.items()}
            if self.start is not None:
                return {n: self.start.get(n, 0) for n in found}
            if lost := {n: o for n, o in first.items() if o > 0}:
                raise ValueError(f"the log begins above offset 0: {lost}")
            return first

        def ends(self, found: dict[int, dict[int, list[str]]]) -> dict[int, int]:
            """The offsets behind the last ones: only last segments are read."""
            there = {n: self.rows(own[max(own)])[-1][0] + 1 for n, own in found.items()}
            for n, o in (self.end or {}).items():
                if o > there.get(n, 0):
                    raise ValueError(f"offset {o} of partition {n} isn't there: the log ends at {there.get(n, 0)}")
            return there if self.end is None else {n: self.end.get(n, 0) for n in found}

        def tasks(self, start: dict[int, int], end: dict[int, int]) -> list[InputPartition]:
            found, out = self.segments(), []
            together = -(-sum(len(own) for own in found.values()) // tasks_at_most)
            for n, upto in end.items():
                bases = sorted(found.get(n, {}))
                at = start.get(n, 0)
                if at < upto and (not bases or bases[0] > at):
                    raise ValueError(f"offset {at} of partition {n} isn't there any more")
                run = []
                for base, following in zip(bases, [*bases[1:], upto]):
                    low, high = max(at, base), min(upto, max(following, base))
                    if low < high:
                        run.append((found[n][base], low, high))
                out += [InputPartition((n, run[i : i + together])) for i in range(0, len(run), together)]
            return out

        def values(self, task: InputPartition) -> Iterator[tuple[int, int, bytes | None]]:
            import base64

            n, segments = task.value
            for files, low, high in segments:
                rows = [r for r in self.rows(files) if low <= r[0] < high]
                if [o for o, _ in rows] != list(range(low, high)):
                    raise ValueError(f"offsets {low} to {high} of partition {n} aren't whole: {len(rows)} rows")
                for o, value in rows:
                    yield n, o, None if value is None else base64.b64decode(value)

    class BatchReader(DataSourceReader):
        def __init__(self, options: dict):
            self.log = Log(options)

        def partitions(self) -> list[InputPartition]:
            found = self.log.segments()
            return self.log.tasks(self.log.starts(found), self.log.ends(found))

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return self.log.values(partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.log = Log(options)

        def initialOffset(self) -> dict:
            return {str(n): o for n, o in self.log.starts(self.log.segments()).items()}

        def latestOffset(self, *_) -> dict:
            return {str(n): o for n, o in self.log.ends(self.log.segments()).items()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            number = lambda offsets: {int(n): o for n, o in offsets.items()}
            return self.log.tasks(number(start), number(end))

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return self.log.values(partition)

        def commit(self, end: dict) -> None:
            pass  # the checkpoint has the offsets

    class OffsetLog(DataSource):
        @classmethod
        def name(cls) -> str:
            return "offset_log"

        def schema(self) -> str:
            return "partition int, offset long, value binary"

        def reader(self, schema) -> DataSourceReader:
            return BatchReader(dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(dict(self.options))

    return OffsetLog


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log's rows from the start to `endingOffsets`, or to the ends that are there when it is planned."""
    spark.dataSource.register(log_source())
    return spark.read.format("offset_log").options(**options).load(path)


def stream_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log as a stream of raw payloads."""
    spark.dataSource.register(log_source())
    return spark.readStream.format("offset_log").options(**options).load(path)
