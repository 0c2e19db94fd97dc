"""FITS images: headers and pixels of every image in a folder, and images built from pixels.

Files come through Spark's binary reader, so any store it can open will do; each file is parsed in
the task that reads it. Pixels are tile rows, so that a file's band of rows stays one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_header(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Keywords of the header at ``at`` and where its data begin."""
    found: dict[str, str] = {}
    while at + BLOCK <= len(data):
        block = data[at : at + BLOCK].decode("latin-1")
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD]
            key = card[:8].strip()
            if key == "END":
                return found, at
            if card[8:10] == "= ":
                value = card[10:].lstrip()
                found[key] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()
    raise ValueError("the header has no END card")


def images(data: bytes) -> Iterator[tuple[int, dict[str, str], np.ndarray | None]]:
    """(HDU number, keywords, pixels or None) of each HDU; blank pixels are NaN."""
    at, hdu = 0, 0
    while at < len(data):
        head, at = parse_header(data, at)
        shape = [int(head[f"NAXIS{k}"]) for k in range(int(head.get("NAXIS", "0")), 0, -1)]
        kind = np.dtype(_KINDS[int(head.get("BITPIX", "8"))])
        size = int(np.prod(shape)) * kind.itemsize if shape else 0
        pixels = None
        if shape and head.get("XTENSION", "IMAGE") == "IMAGE":
            raw = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
            pixels = raw.astype(float) * float(head.get("BSCALE", "1")) + float(head.get("BZERO", "0"))
            if "BLANK" in head and kind.kind in "iu":
                pixels[raw == int(head["BLANK"])] = np.nan
        yield hdu, head, pixels
        at += -(-size // BLOCK) * BLOCK
        hdu += 1


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.fits*").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, hdu, header) of every HDU; a file that can't be read has a null header and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(file, hdu, head, None) for hdu, head, _ in images(_plain(file, data))]
                except (ValueError, KeyError) as e:
                    rows.append((file, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "hdu", "header", "error"])

    return _files(spark, path, recursive).mapInPandas(run, "path string, hdu int, header map<string,string>, error string")


def _plain(file: str, data: bytes) -> bytes:
    if file.endswith(".gz"):
        import gzip

        return gzip.decompress(data)
    return data


def read_pixels(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, hdu, j, data) with one image row a record; use :func:`long_view` for single pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                for hdu, _, pixels in images(_plain(file, data)):
                    if pixels is not None and pixels.ndim == 2:
                        yield pd.DataFrame({"path": file, "hdu": hdu, "j": np.arange(len(pixels)), "data": list(pixels)})

    return _files(spark, path, recursive).mapInPandas(run, "path string, hdu int, j int, data array<double>")


def long_view(rows: DataFrame) -> DataFrame:
    """One row a pixel; NaN and infinities are blank."""
    return rows.select("path", "hdu", "j", F.posexplode("data").alias("i", "v")).withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v")))


def to_fits(pixels: np.ndarray, keywords: dict[str, str | float] | None = None) -> bytes:
    """A primary image of 64-bit floats."""
    def card(key, value, text=False):
        return (f"{key:<8}= " + (f"'{value:<8}'" if text else f"{value:>20}")).ljust(CARD)

    cards = [card("SIMPLE", "T"), card("BITPIX", -64), card("NAXIS", pixels.ndim)]
    cards += [card(f"NAXIS{k + 1}", n) for k, n in enumerate(reversed(pixels.shape))]
    cards += [card(k, v, isinstance(v, str)) for k, v in (keywords or {}).items()]
    head = ("".join(cards) + "END".ljust(CARD)).encode("latin-1")
    body = np.ascontiguousarray(pixels, ">f8").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def assemble(pix: DataFrame, nx: int, ny: int, template: dict[str, str | float] | None = None) -> DataFrame:
    """(image_id, fits): the file of each image, built in one task an image (a bounded grid); blanks are NaN.
    With a template's keywords the image is cut to the range that has pixels, and its reference
    pixel moves along; a template's own size is not kept."""
    def build(g: pd.DataFrame) -> pd.DataFrame:
        out = np.full((ny, nx), np.nan)
        own = g.dropna(subset=["v"])
        i, j = own["i"].to_numpy(int), own["j"].to_numpy(int)
        out[j, i] = own["v"].to_numpy(float)
        if template is None:
            return pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "fits": [to_fits(out)]})
        words = {k: v for k, v in template.items() if not k.startswith(("NAXIS", "SIMPLE", "BITPIX"))}
        if len(i):
            out = out[j.min() : j.max() + 1, i.min() : i.max() + 1]
            for key, first in (("CRPIX1", i.min()), ("CRPIX2", j.min())):
                if key in words:
                    words[key] = float(words[key]) - float(first)
        return pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "fits": [to_fits(out, words)]})

    return pix.filter(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1)).select("image_id", "i", "j", "v").groupBy("image_id").applyInPandas(build, "image_id int, fits binary")
