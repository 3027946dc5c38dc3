"""Sources: acquisition folders as tile catalogs, their settings, and scans of their pixels.

Folders are listed by Spark's binaryFile source, whose content column is left unread, so any file system that Spark
reaches will do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import snake_col, snake_row
from ..operators import grid
from . import images

#: Formats of tile folders and the files that tell them.
TYPES = {"apr": r"\.apr$", "tiff3D": r"\.tif$", "raw": r"\.raw$"}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, folder, length`` of all files below a folder; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), "length")


def file_type(files: DataFrame, root: str) -> str:
    """The one type that a folder holds: apr, tiff3D, raw, or tiff2D for sub-folders; ValueError for none or several."""
    depth = F.size(F.split("path", "/"))
    base = len(root.rstrip("/").split("/")) if "://" in root else None
    top = files.agg(F.min(depth)).first()[0] if base is None else base + 1
    row = files.agg(*[F.max((F.col("name").rlike(p) & (depth == top)).cast("int")).alias(k) for k, p in TYPES.items()], F.max((depth > top).cast("int")).alias("tiff2D")).first()
    found = [k for k, v in row.asDict().items() if v]
    if len(found) != 1:
        raise ValueError(f"exactly one kind of tile is needed, found {found or 'none'}")
    return found[0]


def by_pattern(files: DataFrame, pattern: str = r"(\d+)_(\d+)\.", column: str = "name") -> DataFrame:
    """Tiles by row and column numbers in the name; names that don't match are left out."""
    part = lambda k: F.expr(f"try_cast(regexp_extract({column}, r'{pattern}', {k}) as int)")
    return files.select("path", part(1).alias("row"), part(2).alias("col")).where("row is not null and col is not null")


def catalog(files: DataFrame, ftype: str, frame_size: int = 2048) -> DataFrame:
    """A grid of tiles: offsets from 0, one tile a cell. FileNotFoundError if there is none."""
    source = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.col("folder").alias("name")).distinct() if ftype == "tiff2D" else files.where(F.col("name").rlike(TYPES[ftype]))
    tiles = by_pattern(source.withColumn("name", F.concat("name", F.lit("."))))
    if tiles.isEmpty():
        raise FileNotFoundError("no tiles found")
    placed = grid.normalise_offset(grid.unique_tiles(tiles))
    return placed.withColumns({"ftype": F.lit(ftype), "frame_size": F.lit(frame_size)})


def independent(files: DataFrame, ftype: str) -> DataFrame:
    """Tiles without a grid."""
    return files.where(F.col("name").rlike(TYPES[ftype])).select("path", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(ftype).alias("ftype"))


def settings(lines: DataFrame, pattern: str = r"^(\w+)\s*=\s*\"?([^\"]*?)\"?\s*$") -> DataFrame:
    """``key, value, number, flag`` of text lines ``(value)`` such as  Key = value  or  key = "value"."""
    got = lines.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value")).where("key <> ''")
    return got.withColumns({"number": F.expr("try_cast(value as double)"), "flag": F.expr("try_cast(value as boolean)")})


def setting(table: DataFrame, key: str) -> float:
    row = table.where(F.col("key") == key).select("number").first()
    if row is None or row[0] is None:
        raise KeyError(key)
    return row[0]


class Colm:
    """COLM: frames in VW0/LOC*/, grid shape in a matrix file, overlaps in an ini file."""

    name = "colm"

    @staticmethod
    def accepts(files: DataFrame) -> bool:
        return not files.where("name = 'Experiment.ini'").isEmpty()

    @staticmethod
    def n_channels(files: DataFrame) -> int:
        return files.agg(F.max(F.expr(r"try_cast(regexp_extract(name, r'CHN(\d+)', 1) as int)")) + 1).first()[0]

    @staticmethod
    def shape(spark: SparkSession, path: str) -> tuple[int, int]:
        rows = spark.read.text(f"{path}/Scanned Cells.txt").where("trim(value) <> ''")
        r = rows.agg(F.count("*"), F.max(F.size(F.split("value", ",")))).first()
        return r[0], r[1]

    @staticmethod
    def tiles(files: DataFrame, ncol: int, channel: int = 0) -> DataFrame:
        """Frames by tile: ``path, row, col, name``."""
        n = F.expr(r"try_cast(regexp_extract(folder, r'LOC(\d+)', 1) as int)")
        some = files.where(F.col("path").contains("/VW0/") & F.col("name").contains(f"CHN0{channel}_")).withColumn("_n", n).where("_n is not null")
        return some.select("path", F.floor(F.col("_n") / ncol).cast("int").alias("row"), (F.col("_n") % ncol).cast("int").alias("col"), "name")

    @staticmethod
    def overlap(table: DataFrame) -> tuple[float, float]:
        """Vertical and horizontal overlap in percent, from the ini file's settings."""
        return setting(table, "PercentOverlapV" if not table.where("key = 'PercentOverlapV'").isEmpty() else "Vertical"), setting(table, "PercentOverlapH" if not table.where("key = 'PercentOverlapH'").isEmpty() else "Horizontal")


class ClearScope:
    """ClearScope: frames in 000000_<tile>___<channel>c/, tiles numbered from 1 in serpentine order."""

    name = "clearscope"

    @staticmethod
    def accepts(files: DataFrame) -> bool:
        return not files.where(F.col("folder").rlike(r"^\d{6}_\d{6}___\d+c$")).isEmpty()

    @staticmethod
    def n_channels(files: DataFrame) -> int:
        return files.agg(F.max(F.expr(r"try_cast(regexp_extract(folder, r'__(\d+)c', 1) as int)")) + 1).first()[0]

    @staticmethod
    def shape(table: DataFrame) -> tuple[int, int, int]:
        """nrow, ncol and planes from the settings."""
        return int(setting(table, "ScanGridY")), int(setting(table, "ScanGridX")), int(setting(table, "StackDepths"))

    @staticmethod
    def frames(files: DataFrame, ncol: int) -> DataFrame:
        """``path, tile, channel, n, row, col`` of every frame."""
        number = lambda c, p: F.expr(f"try_cast(regexp_extract({c}, r'{p}', 1) as int)")
        got = files.select("path", number("folder", r"^\d{6}_(\d{6})___").alias("tile"), number("folder", r"___(\d+)c").alias("channel"), number("name", r"___(\d{6})_").alias("n")).where("tile is not null and n is not null")
        return got.withColumns({"row": snake_row(F.col("tile"), ncol), "col": snake_col(F.col("tile"), ncol)})


class Tiles:
    """Plain folders of <row>_<col> files."""

    name = "tiles"

    @staticmethod
    def accepts(files: DataFrame) -> bool:
        return not files.where(F.col("name").rlike(r"^\d+_\d+\.(apr|tif|raw)$")).isEmpty()

    @staticmethod
    def n_channels(files: DataFrame) -> int:
        return files.agg(F.coalesce(F.max(F.expr(r"try_cast(regexp_extract(path, r'/ch(\d+)/', 1) as int)")), F.lit(0)) + 1).first()[0]


#: Acquisition kinds by name; more can be added.
REGISTRY: dict[str, type] = {c.name: c for c in (ClearScope, Colm, Tiles)}


def detect(files: DataFrame) -> type | None:
    """The first kind, by name, that accepts the files."""
    return next((REGISTRY[k] for k in sorted(REGISTRY) if REGISTRY[k].accepts(files)), None)


def n_channels(files: DataFrame) -> int:
    kind = detect(files)
    if kind is None:
        raise ValueError("no known acquisition")
    return kind.n_channels(files)


def decoder(ftype: str, frame_size: int) -> Callable[[bytes], np.ndarray]:
    if ftype == "raw":
        return lambda data: images.decode_raw(data, frame_size)
    if ftype == "npy":
        return lambda data: np.atleast_3d(images.decode_npy(data))
    return images.decode_tiff


def scan_voxels(tiles: DataFrame, ftype: str, frame_size: int, background: int | None = None) -> DataFrame:
    """``row, col, z, y, x, v`` of tiles ``(path, row, col[, z0])``; z0 is the plane of a file's first frame.

    A task decodes one file at a time.  Values at or below background are left out.
    """
    spark = tiles.sparkSession
    read = decoder(ftype, frame_size)
    z0 = F.col("z0") if "z0" in tiles.columns else F.lit(0)
    paths = tiles.select(F.col("path").alias("_p"), "row", "col", z0.cast("int").alias("z0"))
    roots = [r[0] for r in tiles.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]  # folders of one acquisition
    files = spark.read.format("binaryFile").load(roots).select("path", "content").join(paths, F.col("path") == F.col("_p"))

    def run(batches):
        for b in batches:
            for content, row, col, z in zip(b.content, b.row, b.col, b.z0, strict=True):
                volume = read(content)
                at = np.nonzero(volume > background) if background is not None else tuple(g.ravel() for g in np.indices(volume.shape))
                for k in range(0, len(at[0]), 1 << 20):
                    zz, yy, xx = (a[k : k + (1 << 20)] for a in at)
                    yield pd.DataFrame({"row": row, "col": col, "z": (zz + z).astype("int32"), "y": yy.astype("int32"), "x": xx.astype("int32"), "v": volume[zz, yy, xx].astype("int32")})

    return files.select("content", "row", "col", "z0").mapInPandas(run, "row int, col int, z int, y int, x int, v int")


def check_integrity(files: DataFrame, ftype: str, frame_size: int) -> DataFrame:
    """``path, ok, error``: whether each file can be decoded; files: as the binaryFile source gives them."""
    read = decoder(ftype, frame_size)

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    read(content)
                    out.append((path, True, None))
                except Exception as e:  # whatever a damaged file makes a decoder raise
                    out.append((path, False, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "ok", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, error string")


def darkest_corner(voxels: DataFrame, side: int = 50) -> DataFrame:
    """``ip_th``: the whole part of the mean of the first frame's corner."""
    return voxels.where(f"z = 0 and y < {side} and x < {side}").agg(F.floor(F.avg("v")).cast("int").alias("ip_th"))
