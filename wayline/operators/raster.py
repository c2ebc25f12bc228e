"""Class samples from a pixel table: neighbourhood, palette, majority with a prior for land."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Pixels on a side of a block.
BLOCK = 32
LAST_RESORT = "water"

# Colours and classes of the land-cover product, and the class sets that the measures use.
PALETTE = [
    (0, 100, 0, 10, "tree_cover"),
    (255, 187, 34, 20, "shrubland"),
    (255, 255, 76, 30, "grassland"),
    (240, 150, 255, 40, "cropland"),
    (250, 0, 0, 50, "built_up"),
    (180, 180, 180, 60, "bare"),
    (240, 240, 240, 70, "snow_ice"),
    (0, 100, 200, 80, "water"),
    (0, 150, 160, 90, "wetland"),
    (0, 207, 117, 95, "mangroves"),
    (250, 230, 160, 100, "moss_lichen"),
]
SHADE_CLASSES = ("tree_cover",)
GREEN_CLASSES = ("tree_cover", "shrubland", "grassland", "cropland", "wetland")
# End of fixed values.


def palette(spark) -> DataFrame:
    return spark.createDataFrame(PALETTE, "r int, g int, b int, code int, klass string")


def majority(votes: DataFrame, *by: str, klass: str = "klass", order: str = "ord", last_resort: str = LAST_RESORT) -> DataFrame:
    """*by, klass: the most frequent class but last_resort, which wins only alone; of equal counts the first in order."""
    counts = votes.filter(F.col(klass).isNotNull()).groupBy(*by, klass).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = F.struct((F.col(klass) != last_resort).alias("a"), F.col("n").alias("b"), F.struct((-F.col("first").cast("long")).alias("c")))
    return counts.groupBy(*by).agg(F.max_by(klass, rank).alias(klass))


def sample_classes(samples: DataFrame, pixels: DataFrame, classes: DataFrame, half: int = 1, block: int = BLOCK) -> DataFrame:
    """samples (px, py, more) with klass and code of the majority around each; null where no pixel has a known colour.

    A block stencil: pixels are gathered in blocks of block x block with a border of half on each side, so a pixel by the
    rim is in a few of them; samples are packed by block as they are read, and go to their block once, not once for each pixel
    around them. Inside the block the neighbours are read from one grid. A pack holds samples of one batch, so a block
    with many samples is many packs, and a skewed join can be split.
    Of several known colours of one pixel the lowest code counts. classes: a palette of few rows.
    """
    side = block + 2 * half
    known = pixels.join(classes.select("r", "g", "b", "code", "klass"), ["r", "g", "b"]).select("px", "py", "code", (F.col("klass") == LAST_RESORT).alias("last"))
    near = lambda c: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + o) / block) for o in (-half, half)))))
    placed = known.withColumn("bx", near("px")).withColumn("by", near("py"))
    at = ((F.col("py") - F.col("by") * block + half) * side + F.col("px") - F.col("bx") * block + half).cast("int")
    blocks = placed.groupBy("bx", "by").agg(F.array_sort(F.collect_set(F.struct(at.alias("at"), F.col("code").cast("int").alias("code"), "last"))).alias("cells"))
    names, types = samples.columns, samples.schema
    packed = StructType([StructField("bx", LongType()), StructField("by", LongType()), StructField("rows", ArrayType(types))])
    voted = StructType([*types.fields, StructField("code", IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.floor_divide(pc.fill_null(batch.column(names.index(c)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False), block) for c in ("px", "py"))
                order = np.lexsort((x, y))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]))
                rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)).take(pa.array(order))
                cut = pa.array(np.concatenate([first, [batch.num_rows]]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x[order][first]), pa.array(y[order][first]), pa.ListArray.from_arrays(cut, rows)], names=["bx", "by", "rows"])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, by, rows, cells in zip(*batch.columns, strict=True):
                rows, n = rows.values, len(rows.values)
                px, py = (pc.struct_field(rows, names.index(c)).cast(pa.int64()) for c in ("px", "py"))
                there = pc.and_(px.is_valid(), py.is_valid()).to_numpy(zero_copy_only=False)
                code = np.full(n, -1, np.int64)
                if cells.is_valid and there.any():
                    cells = cells.values
                    grid, last = np.full(side * side, -1, np.int64), {c for c, l in zip(pc.struct_field(cells, 1).to_pylist(), pc.struct_field(cells, 2).to_pylist(), strict=True) if l}
                    grid[pc.struct_field(cells, 0).to_numpy()[::-1]] = pc.struct_field(cells, 1).to_numpy()[::-1]
                    x = pc.fill_null(px, 0).to_numpy() - bx.as_py() * block
                    y = pc.fill_null(py, 0).to_numpy() - by.as_py() * block
                    around = np.stack([grid[np.where(there, (y + dy) * side + x + dx, 0)] for dy in range(2 * half + 1) for dx in range(2 * half + 1)], axis=1)
                    code = np.where(there, _majority(around, last), -1)
                found = pa.array(code, pa.int32(), mask=code < 0)
                yield pa.RecordBatch.from_arrays([*rows.flatten(), found], names=[*names, "code"])

    packs = samples.mapInArrow(pack, packed).join(blocks, ["bx", "by"], "left").select("bx", "by", "rows", "cells")
    return packs.mapInArrow(vote, voted).join(classes.select("code", "klass"), "code", "left").select(*names, "klass", "code")


def _majority(around: np.ndarray, last: set[int]) -> np.ndarray:
    """Of each row of codes (-1: none) the most frequent but those of last, which win only alone; of equal counts the first."""
    best, rank = np.full(len(around), -1, np.int64), np.full(len(around), -1, np.int64)
    width = around.shape[1]
    for code in np.unique(around[around >= 0]):
        hit = around == code
        n, first = hit.sum(axis=1), hit.argmax(axis=1)
        own = np.where(n > 0, ((0 if code in last else width + 1) + n) * width + (width - 1 - first), -1)
        best, rank = np.where(own > rank, code, best), np.maximum(own, rank)
    return best
