"""Text files that grow, followed by byte.

Spark's file source takes a file once; this source remembers a byte per file,
so lines appended to a known file are read, and a line without its end waits
until the end is written.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FORMAT = "tagtide_tail"
SCHEMA = "file string, at bigint, line string"
RANGE_BYTES = 64 << 20


def register_tail(spark: SparkSession) -> str:
    """Register the source and return its format's name.

    Options: ``path`` (a folder; files whose names begin with ``.`` or ``_``
    are passed over) and ``range_bytes``.  Rows are (file, at, line): ``at`` is
    the byte where the line begins.  The offset is the end of the last whole
    line by file, so it grows with the files of the folder, not with their
    lines.  A batch is cut into ranges of ``range_bytes``; the line that
    crosses an edge belongs to the range where it begins.  A file may grow or
    go, but what was read of it must not change; a file shorter than its
    offset raises.  Lines end at ``\\n``; one that is no UTF-8 gets replacement
    characters.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Range(InputPartition):
        def __init__(self, path, lo, hi, within):
            self.path, self.lo, self.hi, self.within = path, lo, hi, within

    # local classes travel with the plan: the workers need not import this package
    class TailReader(DataSourceStreamReader):
        block = 1 << 20

        def __init__(self, path, range_bytes):
            self.path, self.range_bytes = path, range_bytes

        def open(self):
            from pyarrow import fs
            return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

        def files(self):
            from pyarrow import fs
            store, root = self.open()
            found = store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
            return store, {f.path: f.size for f in found if f.is_file and f.base_name[0] not in "._"}

        def initialOffset(self):
            return {}

        def latestOffset(self):
            store, sizes = self.files()
            return {path: end for path, size in sorted(sizes.items()) if (end := self.whole(store, path, size))}

        def whole(self, store, path, size):
            """End of the last whole line within the first ``size`` bytes."""
            with store.open_input_file(path) as f:
                while size:
                    lo = max(0, size - self.block)
                    at = f.read_at(size - lo, lo).rfind(b"\n")
                    if at >= 0:
                        return lo + at + 1
                    size = lo
            return 0

        def partitions(self, start, end):
            out = []
            for path, stop in end.items():
                begin = start.get(path, 0)
                if stop < begin:
                    raise ValueError(f"{path} is shorter than what was read of it: {stop} bytes after {begin}")
                for lo in range(begin, stop, self.range_bytes):
                    out.append(Range(path, lo, min(stop, lo + self.range_bytes), (begin, stop)))
            return out

        def read(self, part):
            store, _ = self.open()
            begin, stop = part.within
            skip = part.lo > begin  # the line under way before this range belongs to the one before
            at = part.lo - skip
            with store.open_input_file(part.path) as f:
                f.seek(at)
                held, fresh = [], at
                while fresh < stop and at < part.hi:
                    got = f.read(min(self.block, stop - fresh))
                    if not got:
                        raise EOFError(f"{part.path} ends at {fresh}, before {stop}")
                    fresh += len(got)
                    *lines, rest = got.split(b"\n")
                    for line in lines:
                        if at >= part.hi:
                            break
                        line = b"".join([*held, line])
                        held = []
                        if not skip:
                            yield (part.path, at, line.decode("utf-8", "replace"))
                        skip = False
                        at += len(line) + 1
                    else:
                        held.append(rest)

    class Tail(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def schema(self):
            return SCHEMA

        def streamReader(self, schema):
            return TailReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    spark.dataSource.register(Tail)
    return FORMAT


def stream_tail(spark: SparkSession, source: str, table: str, checkpoint: str, range_bytes: int = RANGE_BYTES) -> None:
    """Append every whole line that the files of ``source`` have gained since
    the checkpoint to ``table`` (exactly once)."""
    lines = spark.readStream.format(register_tail(spark)).option("range_bytes", range_bytes).load(source)
    q = (lines.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(table))
    q.awaitTermination()
