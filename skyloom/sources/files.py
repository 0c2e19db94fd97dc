"""Files by name: rows of (path, bytes) written to a folder, status and box lists, header text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_of(uri: str):
    """pyarrow's file system of a folder that all executors see, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's bytes to ``folder/path``; (path, n_bytes) of what was written. A task that runs again
    writes the same files again. Lazy: the files exist after an action on the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = folder_of(folder)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, data in zip(names, batch.column(1), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is not within the folder")
                files.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(data.as_buffer())
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return rows.select(path, content).mapInArrow(run, "path string, n_bytes long")


def struct_value(text: Column, key: str) -> Column:
    """The value of a key of ``[struct stat="OK", count=5, ...]``, as text without its quotes; null where there is none."""
    quoted = F.regexp_extract(text, rf'(?:^|[\s,\[]){key}\s*=\s*"([^"]*)"', 1)
    plain = F.regexp_extract(text, rf"(?:^|[\s,\[]){key}\s*=\s*([^\s,\]\"\[]+)", 1)
    nested = F.regexp_extract(text, rf"(?:^|[\s,\[]){key}\s*=\s*(\[[^\]]*\])", 1)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (quoted, plain, nested)])


def fit_status(lines: DataFrame) -> DataFrame:
    """Fit results from their status texts (plus, minus, text): a, b, c, rms and npixel of those that succeeded."""
    numbers = [struct_value(F.col("text"), k).try_cast("double").alias(k) for k in ("a", "b", "c", "rms")]
    return lines.filter(struct_value(F.col("text"), "stat") == "OK").select("plus", "minus", *numbers, struct_value(F.col("text"), "npixel").try_cast("long").alias("npixel"))


def read_status_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file of a folder, whole."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.trim("value").alias("text"))


def box_lines(lines: DataFrame) -> DataFrame:
    """Boxes (xmin, xmax, ymin, ymax) of text lines with four numbers; other lines are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    box = [F.get(cells, F.lit(k)).try_cast("int") for k in range(4)]
    return lines.filter(F.size(cells) >= 4).select(*[b.alias(n) for b, n in zip(box, ("xmin", "xmax", "ymin", "ymax"), strict=True)]).dropna()


def mask_by_boxes(pix: DataFrame, boxes: DataFrame, side: int = 16) -> DataFrame:
    """``pix`` with the pixels in any inclusive box blank. Boxes and pixels meet in grid cells of ``side``, so a
    long list of boxes isn't part of the plan; a pixel in several boxes stays one row."""
    axis = lambda a, b: F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))
    dealt = boxes.filter("xmin <= xmax AND ymin <= ymax").select("*", F.explode(axis("xmin", "xmax")).alias("cx")).select("*", F.explode(axis("ymin", "ymax")).alias("cy"))
    celled = pix.withColumns({"cx": F.floor(F.col("i") / side), "cy": F.floor(F.col("j") / side)})
    inside = F.col("i").between(F.col("xmin"), F.col("xmax")) & F.col("j").between(F.col("ymin"), F.col("ymax"))
    places = celled.select("i", "j", "cx", "cy").distinct().join(dealt, ["cx", "cy"]).filter(inside).select("i", "j").distinct().withColumn("masked", F.lit(True))
    return pix.join(places, ["i", "j"], "left").select(*[F.when(F.col("masked").isNull(), F.col("v")).alias("v") if c == "v" else F.col(c) for c in pix.columns])
