"""Bars as a data source of their own: spark.read.format("bars") over folders of user-supplied bars, a partition for each symbol and year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COLUMNS = ("time", "open", "high", "low", "close", "volume")
SCHEMA = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double"
#: bars that a look back may ask for
LEAST, MOST = 10, 1000


@dataclass
class Part(InputPartition):
    symbol: str
    year: int
    files: list[str] = field(default_factory=list)
    since: dt.datetime | None = None


class BarsReader(DataSourceReader):
    """Parts of <path>/symbol=S/year=Y/*.parquet that the filters leave. Symbols and years come from folder names, so what isn't needed isn't opened."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        self.symbols: set[str] | None = None
        self.low, self.high = dt.datetime.min, dt.datetime.max
        last = options.get("last")
        self.last = max(LEAST, min(MOST, int(last))) if last else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols are met wholly by the choice of parts; times choose years, and Spark filters the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = found if self.symbols is None else self.symbols & found
                continue
            if getattr(f, "attribute", None) == ("time",) and isinstance(getattr(f, "value", None), dt.datetime):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def _folders(self, root: str, name: str) -> list[tuple[str, str]]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(root))
        return sorted((unquote(i.base_name.removeprefix(f"{name}=")), i.path) for i in found if i.type == pyarrow.fs.FileType.Directory and i.base_name.startswith(f"{name}="))

    def _rows(self, path: str) -> int:
        with self.fs.open_input_file(path) as f:
            return pq.ParquetFile(f).metadata.num_rows

    def partitions(self) -> list[Part]:
        """For a look back only a symbol's last years are taken, by the row counts in the files' footers, until they hold enough bars."""
        out = []
        for symbol, folder in self._folders(self.root, "symbol"):
            if self.symbols is not None and symbol not in self.symbols:
                continue
            held = 0
            for year, path in sorted(((int(y), p) for y, p in self._folders(folder, "year")), reverse=True):
                if not self.low.year <= year <= self.high.year:
                    continue
                if self.last and held >= self.last:
                    break
                files = sorted(i.path for i in self.fs.get_file_info(pyarrow.fs.FileSelector(path)) if i.base_name.endswith(".parquet"))
                held += sum(map(self._rows, files)) if self.last else 0
                out.append(Part(symbol, year, files))
        return out or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for path in part.files:
            with self.fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=list(COLUMNS)):
                    cells = [pa.array([part.symbol] * batch.num_rows, pa.string()), batch.column("time").cast(pa.timestamp("us")), *[batch.column(c).cast(pa.float64()) for c in COLUMNS[1:]]]
                    yield pa.record_batch(cells, names=["symbol", *COLUMNS])


class BarsSource(DataSource):
    """Options: path, a folder written by save_bars(); last, how many bars of each symbol are looked back over (10 to 1000, whatever is asked)."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        return BarsReader(self.options)


def save_bars(bars: DataFrame, path: str) -> None:
    """bars by symbol and year, as the source reads them; null symbols have no folder and are left out."""
    rows = bars.where("symbol is not null").withColumn("year", F.year("time"))
    rows.repartition("symbol", "year").write.mode("overwrite").partitionBy("symbol", "year").parquet(path)


def supplied_bars(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The bars in a folder; with `last` at least so many of each symbol's newest, from the years that hold them: tail() cuts them to size.

    Filters on symbol and time choose folders before anything is opened.
    """
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.dataSource.register(BarsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        reader = spark.read.format("bars").option("path", path)
        return (reader.option("last", str(last)) if last else reader).load()
    finally:
        if before == "true":
            spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
