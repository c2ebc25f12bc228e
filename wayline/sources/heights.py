"""Heights fetched in batches, as a Python data source over a folder of stored responses.

A response answers for the samples of one batch in their order: {"results": [{"elevation": 12.5}, ...]}. It lies as text in
path/batch=<k>/, k from 0. Each partition reads batches of its own from the shared store; a batch whose response is missing, broken
or of another length gives nulls, as a failed request does.

    spark.dataSource.register(StoredHeights)
    spark.read.format("stored_heights").options(path=path, rows=n).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_IN_BATCH = 100


class StoredHeights(DataSource):
    """idx, elev. Options: path, rows (how many samples), batch (samples in a response), batches (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "stored_heights"

    def schema(self) -> str:
        return "idx long, elev double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        o = self.options
        return _Reader(o["path"], int(o["rows"]), int(o.get("batch", ROWS_IN_BATCH)), int(o.get("batches", 1)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, batch: int, batches: int):
        self.path, self.rows, self.batch, self.batches = path, rows, batch, batches

    def partitions(self) -> Sequence[InputPartition]:
        each = self.batch * self.batches
        return [InputPartition(first) for first in range(0, self.rows, each)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        store, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        for first in range(partition.value, min(partition.value + self.batch * self.batches, self.rows), self.batch):
            last = min(first + self.batch, self.rows)
            found = _elevations(store, f"{root}/batch={first // self.batch}", last - first)
            yield pa.RecordBatch.from_arrays([pa.array(range(first, last), pa.int64()), pa.array(found, pa.float64())], names=["idx", "elev"])


def _elevations(store: fs.FileSystem, folder: str, n: int) -> list[float | None]:
    try:
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.size and not f.base_name.startswith((".", "_"))]
        with store.open_input_stream(files[0].path) as f:
            found = [r["elevation"] for r in json.loads(f.read())["results"]]
        return [None if v is None else float(v) for v in found] if len(found) == n else [None] * n
    except (OSError, IndexError, ValueError, KeyError, TypeError):
        return [None] * n


def write_responses(heights: DataFrame, path: str, batch: int = ROWS_IN_BATCH) -> None:
    """Store heights (idx from 0, elev) as responses, a folder for each batch."""
    k = F.floor(F.col("idx") / batch)
    results = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("elev", F.lit(float("nan"))).alias("v")))), lambda r: F.struct(F.nullif(r["v"], F.lit(float("nan"))).alias("elevation")))
    text = F.to_json(F.struct(results.alias("results")), {"ignoreNullFields": "false"})
    heights.groupBy(k.alias("batch")).agg(text.alias("value")).write.partitionBy("batch").text(path)


def read_heights(heights_path: str, samples: DataFrame, rows: int, batch: int = ROWS_IN_BATCH, batches: int = 1) -> DataFrame:
    """samples (idx) with elev of their responses."""
    spark = samples.sparkSession
    spark.dataSource.register(StoredHeights)
    found = spark.read.format("stored_heights").options(path=heights_path, rows=rows, batch=batch, batches=batches).load()
    return samples.join(found, "idx", "left")
