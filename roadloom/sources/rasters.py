"""Elevation rasters as tables of (tile, row, col, metres), one task a file, voids left out.

BIL tiles have a text header beside them; HGT tiles have big-endian 16-bit samples and their south-west corner in the name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HGT_VOID = -32768
SCHEMA = "tile string, row long, col long, metres double, lat double, lng double, resolution double"


def parse_header(text: str) -> dict[str, str]:
    """Keys (upper case) and values of a BIL header; raises where a needed key is missing."""
    found = {m[1].upper(): m[2].strip() for m in re.finditer(r"(?m)^\s*(\w+)\s+(.+?)\s*$", text)}
    missing = {"NROWS", "NCOLS", "ULXMAP", "ULYMAP", "XDIM", "YDIM"} - set(found)
    if missing:
        raise ValueError(f"header lacks {', '.join(sorted(missing))}")
    return found


def bil_pixels(header: dict[str, str], content: bytes) -> np.ndarray:
    bits, kind = int(header.get("NBITS", "16")), header.get("PIXELTYPE", "SIGNEDINT").upper()
    order = ">" if header.get("BYTEORDER", "I").upper() == "M" else "<"
    dtype = f"{order}f4" if kind == "FLOAT" and bits == 32 else f"{order}i2"
    return np.frombuffer(content, dtype).reshape(int(header["NROWS"]), int(header["NCOLS"]))


def hgt_corner(name: str) -> tuple[int, int]:
    m = re.search(r"([NS])(\d{2})([EW])(\d{3})", name.upper())
    if not m:
        raise ValueError(f"no corner in {name}")
    return int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)


def hgt_pixels(content: bytes) -> np.ndarray:
    side = int(round((len(content) // 2) ** 0.5))
    if side not in (1201, 3601) or side * side * 2 != len(content):
        raise ValueError("a tile has 1201 or 3601 samples a side")
    return np.frombuffer(content, ">i2").reshape(side, side)


def _long(tile: str, pixels: np.ndarray, void: float | None, lat: float, lng: float, resolution: float) -> pd.DataFrame:
    rows, cols = np.nonzero(pixels != void) if void is not None else np.nonzero(np.ones(pixels.shape, bool))
    return pd.DataFrame({"tile": tile, "row": rows.astype("int64"), "col": cols.astype("int64"), "metres": pixels[rows, cols].astype("float64"), "lat": lat, "lng": lng, "resolution": resolution})


def read_bil(spark: SparkSession, path: str) -> DataFrame:
    """All .bil files of a folder with their .hdr."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    both = files.filter(F.lower("path").endswith(".bil")).select(stem.alias("stem"), "content").join(files.filter(F.lower("path").endswith(".hdr")).select(stem.alias("stem"), F.col("content").cast("string").alias("header")), "stem")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                h = parse_header(r.header)
                yield _long(r.stem.rsplit("/", 1)[-1], bil_pixels(h, bytes(r.content)), float(h["NODATA"]) if "NODATA" in h else None, float(h["ULYMAP"]), float(h["ULXMAP"]), float(h["XDIM"]))

    return both.mapInPandas(decode, SCHEMA)


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pixels = hgt_pixels(bytes(r.content))
                south, west = hgt_corner(r.path.rsplit("/", 1)[-1])
                yield _long(r.path.rsplit("/", 1)[-1], pixels, HGT_VOID, south + 1.0, float(west), 1.0 / (pixels.shape[0] - 1))

    return files.mapInPandas(decode, SCHEMA)


def best_value(bil: DataFrame, hgt: DataFrame) -> DataFrame:
    """lat, lng, metres: where both kinds have a value for a place, that of the BIL tile."""
    place = lambda t, p: t.select(F.round(F.col("lat") - F.col("row") * F.col("resolution"), 6).alias("lat"), F.round(F.col("lng") + F.col("col") * F.col("resolution"), 6).alias("lng"), "metres", F.lit(p).alias("priority"))
    return place(bil, 0).union(place(hgt, 1)).groupBy("lat", "lng").agg(F.min_by("metres", "priority").alias("metres"))
