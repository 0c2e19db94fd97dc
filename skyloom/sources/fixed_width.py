"""Fixed-width astronomical tables as a Spark data source (``format("fixedwidth")``), read and written.

Header lines start with a bar, whose bars place the columns: names, then optionally types, units and
null strings. ``\\key = value`` lines before them are keywords. Data types are not enforced: numeric
types are cast where they can be and null where not; without a null row nothing is null text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"i": LongType(), "l": LongType(), "d": DoubleType(), "f": DoubleType(), "r": DoubleType(), "c": StringType()}


class Header:
    """Columns (name, first, end, type, null string) and keywords of a table's first lines."""

    def __init__(self, lines: list[str]):
        self.keywords = dict((k.strip(), v.strip()) for k, _, v in (x[1:].partition("=") for x in lines if x.startswith("\\")) if k.strip() and v)
        bars = [x.rstrip("\r\n") for x in lines if x.startswith("|")]
        if not bars:
            raise ValueError("the table has no header line")
        edges = [k for k, c in enumerate(bars[0]) if c == "|"]
        rows = [[line[a + 1 : b].strip() for a, b in zip(edges, edges[1:], strict=False)] for line in bars]
        kinds, nulls = (rows[k] if len(rows) > k else [""] * len(rows[0]) for k in (1, 3))
        self.columns = [(n, a, b + 1, _TYPES.get(t[:1].lower(), StringType()), z) for n, a, b, t, z in zip(rows[0], edges, edges[1:], kinds, nulls, strict=False)]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, t) for n, _, _, t, _ in self.columns])


def header_of(spark: SparkSession, path: str) -> Header:
    """The header of one table; only its first lines leave the executors."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^[\\|]")).limit(1000).collect()
    return Header([r["value"] for r in lines])


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """A table by Spark's own text reader: files split, columns cut out by JVM expressions.
    ``operators.tables.with_record`` numbers the records by a column's order."""
    header = header_of(spark, path)
    data = spark.read.text(path).filter(~F.col("value").rlike(r"^[\\|]") & (F.trim("value") != ""))
    out = []
    for name, a, b, kind, null in header.columns:
        text = F.trim(F.substring("value", a + 1, b - a))
        if null:
            text = F.nullif(text, F.lit(null))
        out.append((text if isinstance(kind, StringType) else text.try_cast(kind)).alias(name))
    return data.select(*out)


def format_fixed_width(df: DataFrame, width: int = 20) -> DataFrame:
    """The data lines of a table, one string a row: right-aligned cells of ``width`` characters.
    Longer values would be cut; they fail instead."""
    cells = []
    for c in df.columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit("null"))
        cells.append(F.when(F.length(text) > width, F.raise_error(F.lit(f"column {c}: value wider than {width}"))).otherwise(F.lpad(text, width, " ")))
    return df.select(F.concat(F.lit(" "), F.concat_ws(" ", *cells), F.lit(" ")).alias("value"))


def header_lines(df: DataFrame, width: int = 20, keywords: dict[str, str] | None = None) -> list[str]:
    names = {"bigint": "int", "int": "int", "double": "double", "float": "double"}
    row = lambda cells: "|" + "|".join(x.rjust(width) for x in cells) + "|"
    kinds = [names.get(t, "char") for _, t in df.dtypes]
    return [*(f"\\{k} = {v}" for k, v in (keywords or {}).items()), row(df.columns), row(kinds), row([""] * len(kinds)), row(["null"] * len(kinds))]


def write_fixed_width(df: DataFrame, path: str, width: int = 20, keywords: dict[str, str] | None = None) -> None:
    """Write a table as text files of one folder; every file starts with the header."""
    head = header_lines(df, width, keywords)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    format_fixed_width(df, width).mapInArrow(with_header, "value string").write.mode("overwrite").text(path)


class FixedWidthDataSource(DataSource):
    """``spark.read.format("fixedwidth").load(path)`` for tables on a path that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "fixedwidth"

    def _header(self) -> Header:
        lines = []
        with open(self.options["path"]) as f:
            for line in f:
                if not line.startswith(("\\", "|")):
                    break
                lines.append(line)
        return Header(lines)

    def schema(self) -> StructType:
        return self._header().schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._header())


class _Reader(DataSourceReader):
    def __init__(self, path: str, header: Header):
        self.path, self.header = path, header

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def value(text: str, kind, null: str):
            text = text.strip()
            if null and text == null:
                return None
            if isinstance(kind, StringType):
                return text
            try:
                return int(text) if isinstance(kind, LongType) else float(text)
            except ValueError:
                return None

        with open(self.path) as f:
            for line in f:
                if line.strip() and not line.startswith(("\\", "|")):
                    yield tuple(value(line[a:b].rstrip("\n"), t, z) for _, a, b, t, z in self.header.columns)
