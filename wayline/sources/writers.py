"""Writers: GeoJSON, aggregate documents, results with a manifest that tells whether they still hold."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import scan

MANIFEST = "manifest.json"


def feature(gtype: Column, coords: Column, properties: Mapping[str, Column]) -> Column:
    """A GeoJSON feature as a string. Empty lists, empty texts and nulls among the properties are left out."""
    pairs = F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))
    shape = F.when(gtype == "Point", F.to_json(F.get(pairs, F.lit(0)))).when(gtype == "LineString", F.to_json(pairs)).when(gtype == "Polygon", F.to_json(F.array(pairs)))
    geometry = F.when(gtype.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), gtype, F.lit('","coordinates":'), shape, F.lit("}")))
    props = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}"))


def truthy(c: Column) -> Column:
    return F.when(F.length(c.cast("string")) > 0, c)


def filled(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def write_features(features: DataFrame, path: str, by: str = "layer") -> None:
    """One folder of JSON lines for each layer; features has by and feature."""
    features.select(by, F.col("feature").alias("value")).write.partitionBy(by).mode("overwrite").text(path)


def collection(features: DataFrame, by: str = "layer", order: str = "pid") -> DataFrame:
    """by, value: one FeatureCollection for each layer, for layers that fit one row (what a map page can load)."""
    rows = F.array_sort(F.collect_list(F.struct(order, "feature")))
    return features.groupBy(by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(rows, lambda r: r["feature"]), ","), F.lit("]}")).alias("value"))


def document(**parts: DataFrame) -> DataFrame:
    """One row, value: a JSON document of small result tables by name."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias(name))
        out = one if out is None else out.crossJoin(one)
    inner = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in parts])
    return out.select(F.concat(F.lit("{"), inner, F.lit("}")).alias("value"))


def orphans(files: DataFrame, used: DataFrame, name: str = "name") -> DataFrame:
    """Files that nothing uses; deleting them is the caller's decision."""
    return files.join(used.select(name).filter(F.col(name).isNotNull()).distinct(), name, "left_anti")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """tiles (z, x, y, content) as files path/z/x/y.png, the names that readers.tile_files reads; a tile that is there is replaced.

    Spark's own writers choose their names, so each task writes its files to the shared store itself; a task that runs again
    writes the same files. Null content, a tile that could not be had, makes no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        n = 0
        for batch in batches:
            for z, x, y, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{root}/{z}/{x}", recursive=True)
                with store.open_output_stream(f"{root}/{z}/{x}/{y}.png") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    tiles.select("z", "x", "y", "content").filter("content is not null").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _names(spark: SparkSession, path: str):
    """The file names of Hadoop below path, and what they are renamed and opened with."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> dict[str, str] | None:
    """What the manifest of the results at path says: its stamp, and under 'folder' where the data is. None: nothing is published."""
    jvm, where, store = _names(spark, f"{path}/{MANIFEST}")
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, stamp: Mapping[str, str], write: Callable[[str], None]) -> str:
    """Have write() put a result into a new folder of path, then make it the published one; its path.

    The manifest is written beside and renamed over the old one, which is one step of the file system and the last. Whatever fails before
    it leaves the old result as it was, and a folder that nothing names.
    """
    folder = f"{hashlib.sha1(json.dumps(sorted(stamp.items())).encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/{folder}")
    jvm, draft, store = _names(spark, f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps({**stamp, "folder": folder}).encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, _names(spark, f"{path}/{MANIFEST}")[1], over)
    return f"{path}/{folder}"


def prune(spark: SparkSession, path: str) -> int:
    """Delete the folders of path that the manifest does not name, once nothing reads them; how many there were."""
    now = published(spark, path)
    _, where, store = _names(spark, path)
    old = [f.getPath() for f in store.listStatus(where) if f.isDirectory() and now and f.getPath().getName() != now["folder"]]
    for p in old:
        store.delete(p, True)
    return len(old)


def computed(spark: SparkSession, path: str, stamp: Mapping[str, str], compute: Callable[[], DataFrame]) -> DataFrame:
    """The table published at path if its manifest has this stamp (input hash, step, version), else compute(), published there."""
    now = published(spark, path)
    if now and now == {**stamp, "folder": now["folder"]}:
        return spark.read.parquet(f"{path}/{now['folder']}")
    return spark.read.parquet(publish(spark, path, stamp, lambda to: compute().write.parquet(to)))


def fingerprint(table: DataFrame, order: str | Sequence[str]) -> str:
    """A digest of a table's rows in order, for a stamp: equal for equal rows, however they are stored. One row comes back."""
    found = scan.ordered_hash(table, [], order, F.concat(F.to_json(F.struct(*table.columns)), F.lit("\n"))).first()
    return found["hash"] if found else ""
