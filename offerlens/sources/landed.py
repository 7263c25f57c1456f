"""Landed answers and updates as data sources of Spark, in Python: what a source's contract asks, replayed from files.

`landed` reads a folder with one folder of JSON lines for each query, `query=<number>`: a partition a query, whose rows keep the order in
which the query gave them. A query with a line that cannot be read gives no rows but one with the error, and no other query is touched
by it. Conditions on query reach the list of partitions, and a price ceiling the reader.

`updates` streams the rows of a folder of Parquet files by a growing number. Its offset is the cursor, the last number read; a poll
admits a bounded number of updates, those with the least numbers after the cursor, and Spark logs where each poll ended before it goes
on, so a stream that is started again goes on at cursor + 1, or repeats the poll that it had not finished. A batch is one poll, through
the driver, or as many as an option says: then the driver reads numbers alone, and each poll is a task that reads its own updates."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: What a query gives: an item's place in the answer and its fields, or an error.
ANSWER = "query int, position int, sku string, title string, url string, price double, error string"
FIELDS = ("sku", "title", "url", "price")
#: About how many bytes a row group of updates has.
GROUP = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def kept(price: float | None, ceiling: float | None) -> bool:
    """Whether an item is taken: one without a price is, and one with a price if that is positive and not above the ceiling."""
    return price is None or (price > 0 and (ceiling is None or price <= ceiling))


class LandedQuery(InputPartition):
    def __init__(self, query: int, folder: str, ceiling: float | None):
        self.query, self.folder, self.ceiling = query, folder, ceiling


class LandedReader(DataSourceReader):
    def __init__(self, path: str, ceiling: float | None):
        self.path, self.ceiling, self.queries = path, ceiling, None

    def pushFilters(self, filters: list[Filter]):
        """Keeps conditions on query for the list of partitions. An upper bound of price cannot drop rows for Spark, as it keeps none without a price."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = wanted if self.queries is None else self.queries & wanted
                continue
            if isinstance(f, LessThanOrEqual) and f.attribute == ("price",):
                self.ceiling = f.value if self.ceiling is None else min(self.ceiling, f.value)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, base = _opened(self.path)
        found = {int(x.base_name.split("=")[1]): x.base_name for x in files.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and x.base_name.startswith("query=")}
        return [LandedQuery(q, f"{self.path}/{found[q]}", self.ceiling) for q in sorted(found) if self.queries is None or q in self.queries]

    def _lines(self, folder: str) -> Iterator[tuple]:
        files, base = _opened(folder)
        position = 0
        for info in sorted(files.get_file_info(fs.FileSelector(base)), key=lambda x: x.base_name):
            if info.base_name.startswith(("_", ".")):
                continue
            with files.open_input_stream(info.path) as raw:
                text, held = raw, b""
                while chunk := text.read(1 << 20):
                    *lines, held = (held + chunk).split(b"\n")
                    for line in lines:
                        yield position, self._item(line)
                        position += 1
                if held:
                    yield position, self._item(held)
                    position += 1

    @staticmethod
    def _item(line: bytes) -> dict:
        item = json.loads(line)
        if not isinstance(item, dict) or item.get("sku") is None:
            raise ValueError("an item without a sku")
        return item

    def read(self, partition: LandedQuery | None) -> Iterator[tuple]:
        """The query's items that are kept, in their order. The lines are read once to know that all can be, and again to give them, so none is held."""
        if partition is None:  # no query is left to read
            return
        try:
            for _, item in self._lines(partition.folder):
                kept(item.get("price"), partition.ceiling)
        except Exception as e:  # whatever is wrong with one answer, the others go on
            yield partition.query, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for position, item in self._lines(partition.folder):
            price = item.get("price")
            if kept(price, partition.ceiling):
                yield partition.query, position, str(item["sku"]), item.get("title"), item.get("url"), None if price is None else float(price), None


class Landed(DataSource):
    """Options: path, and ceiling, the highest price that is taken."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema: StructType) -> DataSourceReader:
        ceiling = self.options.get("ceiling")
        return LandedReader(self.options["path"].rstrip("/"), float(ceiling) if ceiling else None)


class UpdatesReader(SimpleDataSourceStreamReader):
    """Polls of at most `most` updates, which pass through the driver as a bot's do."""

    def __init__(self, path: str, column: str, columns: Sequence[str], start: int, most: int):
        self.path, self.column, self.columns, self.start, self.most = path, column, list(columns), start, most

    def _files(self) -> list:
        files, base = _opened(self.path)
        return [pq.ParquetFile(files.open_input_file(x.path)) for x in files.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(".parquet")]

    def _rows(self, after: int, upto: int | None) -> list[tuple]:
        """The updates after a number, up to another or, without one, the least ones that a poll admits; files and row groups beyond are not read."""
        groups = []
        for file in self._files():
            at = file.schema_arrow.get_field_index(self.column)
            for k in range(file.num_row_groups):
                stats = file.metadata.row_group(k).column(at).statistics
                known = stats is not None and stats.has_min_max
                if not known or (stats.max > after and (upto is None or stats.min <= upto)):
                    groups.append((stats.min if known else after, file, k))
        best = None
        for least, file, k in sorted(groups, key=lambda g: g[0]):
            if best is not None and upto is None and best.num_rows >= self.most and least > best.column(self.column)[-1].as_py():
                break
            t = file.read_row_group(k, columns=self.columns)
            fits = pc.field(self.column) > after
            t = t.filter(fits if upto is None else fits & (pc.field(self.column) <= upto))
            t = t if best is None else pa.concat_tables([best, t])
            best = t.sort_by(self.column)
            if upto is None and best.num_rows > self.most:
                last = best.column(self.column)[self.most - 1].as_py()  # of one number all or none
                best = best.filter(pc.field(self.column) <= last)
        return [] if best is None else list(zip(*(best.column(c).to_pylist() for c in self.columns), strict=True))

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["cursor"], None)
        at = self.columns.index(self.column)
        return iter(rows), {"cursor": rows[-1][at] if rows else start["cursor"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["cursor"], end["cursor"]))

    def commit(self, end: dict) -> None:
        pass  # the cursor is Spark's to keep, in the checkpoint


class Poll(InputPartition):
    """The updates after a number, up to another, and the row groups (file, place) that may hold some."""

    def __init__(self, after: int, upto: int, groups: list[tuple[str, int]]):
        self.after, self.upto, self.groups = after, upto, groups


class PollsReader(DataSourceStreamReader):
    """Batches of up to `polls` polls, the same ones that `one` makes one by one. The offset has the cursor and where each poll of its batch ended.

    What the driver keeps are the bounds of row groups, from footers that it reads once, and what it reads are the numbers of a batch."""

    def __init__(self, one: UpdatesReader, polls: int):
        self.one, self.polls, self.at, self.footers = one, polls, None, {}

    def _groups(self) -> list[tuple]:
        """(least, greatest, file, place) of all row groups, by least number; without bounds where a footer has none."""
        files, base = _opened(self.one.path)
        known, self.footers = self.footers, {}
        for info in files.get_file_info(fs.FileSelector(base)):
            if not info.base_name.endswith(".parquet"):
                continue
            key = info.path, info.size, info.mtime_ns
            self.footers[key] = known[key] if key in known else list(self._bounds(files, info.path))
        return sorted((g for groups in self.footers.values() for g in groups), key=lambda g: (g[0] is not None, g[0]))

    def _bounds(self, files: fs.FileSystem, path: str) -> Iterator[tuple]:
        with pq.ParquetFile(files.open_input_file(path)) as file:
            at = file.schema_arrow.get_field_index(self.one.column)
            for k in range(file.num_row_groups):
                stats = file.metadata.row_group(k).column(at).statistics
                yield (stats.min, stats.max, path, k) if stats is not None and stats.has_min_max else (None, None, path, k)

    def _read(self, groups: Sequence[tuple[str, int]], columns: Sequence[str], after: int, upto: int | None = None) -> Iterator[pa.Table]:
        files, _ = _opened(self.one.path)
        number = pc.field(self.one.column)
        for path, k in groups:
            with pq.ParquetFile(files.open_input_file(path)) as file:
                yield file.read_row_group(k, columns=list(columns)).filter(number > after if upto is None else (number > after) & (number <= upto))

    def initialOffset(self) -> dict:
        return self.one.initialOffset()

    def latestOffset(self) -> dict:
        self.at = self.initialOffset() if self.at is None else self.at
        after, wanted = self.at["cursor"], self.polls * self.one.most
        found = np.empty(0, np.int64)
        for least, greatest, path, k in self._groups():
            if least is not None and (greatest <= after or (len(found) >= wanted and least > found[wanted - 1])):
                continue
            (t,) = self._read([(path, k)], [self.one.column], after)
            found = np.sort(np.concatenate([found, t.column(0).to_numpy()]))
            if len(found) > wanted:
                found = found[: np.searchsorted(found, found[wanted - 1], "right")]
        ends, begin = [], 0
        while begin < len(found) and len(ends) < self.polls:
            ends.append(int(found[min(begin + self.one.most, len(found)) - 1]))
            begin = int(np.searchsorted(found, ends[-1], "right"))  # of one number all or none
        if ends:
            self.at = {"cursor": ends[-1], "ends": ends}
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end if self.at is None else self.at  # a stream that is started again names its last offset first
        ends = [e for e in end.get("ends", [end["cursor"]]) if e > start["cursor"]]
        groups = self._groups() if ends else []
        inside = lambda a, b: [(path, k) for least, greatest, path, k in groups if least is None or (greatest > a and least <= b)]
        return [Poll(a, b, inside(a, b)) for a, b in zip([start["cursor"], *ends], ends)]

    def read(self, partition: Poll) -> Iterator[tuple]:
        for t in self._read(partition.groups, self.one.columns, partition.after, partition.upto):
            yield from zip(*(t.column(c).to_pylist() for c in self.one.columns), strict=True)


class Updates(DataSource):
    """Options: path; column, the growing number; start, the cursor of a first run; most, the updates of a poll; polls, those of a batch. The schema is the reader's to name."""

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> StructType:
        import pyspark.sql.pandas.types as types

        files, base = _opened(self.options["path"])
        return types.from_arrow_schema(pads.dataset(base, filesystem=files, format="parquet").schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        o = self.options
        return UpdatesReader(o["path"].rstrip("/"), o.get("column", "update_id"), schema.names, int(o.get("start", -1)), int(o.get("most", 40)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        polls = int(self.options.get("polls", 1))
        return PollsReader(self.simpleStreamReader(schema), polls) if polls > 1 else super().streamReader(schema)  # which has none, so the simple one is taken


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows both sources from here on and hands conditions to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Landed, Updates):
        spark.dataSource.register(source)
    return spark


def land_answers(rows: DataFrame, folder: str) -> str:
    """rows(query, position, line) as a folder of JSON lines for each query, in their order."""
    rows.repartition("query").sortWithinPartitions("query", "position").select("query", "line").write.partitionBy("query").text(folder)
    return folder


def land_updates(rows: DataFrame, folder: str, column: str = "update_id") -> str:
    """rows as Parquet files of ascending numbers, in small row groups, as a poll reads whole ones."""
    rows.repartitionByRange(column).sortWithinPartitions(column).write.option("parquet.block.size", GROUP).parquet(folder)
    return folder
