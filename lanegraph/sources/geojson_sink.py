"""GeoJSON files: every task writes a part that is a FeatureCollection of its own, and a list of the parts is committed last.

    geojson_sink.register(spark)
    features.write.format("lanegraph_geojson").mode("append").save(folder)      # a column ``feature``: JSON text

Parts are complete files under names of their own; ``_parts.json`` in the folder, put there in one step, names those that
belong to the result with their numbers of features. A reader follows the list, so files of a failed or repeated task are never
read, and the driver removes what a failed write has left. Null features are left out. The folder is a local path
that all tasks share, or a URI that ``pyarrow.fs`` knows. Appending adds to the list; overwriting starts a new one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LIST = "_parts.json"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    fs, place = pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)
    return fs, place.rstrip("/")


@dataclass
class Part(WriterCommitMessage):
    name: str
    features: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        fs, place = _folder(path)
        fs.create_dir(place, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, place = _folder(self.path)
        name, n = f"part-{uuid.uuid4().hex}.geojson", 0
        with fs.open_output_stream(f"{place}/{name}") as out:
            out.write(b'{"type":"FeatureCollection","features":[')
            for batch in iterator:
                for text in batch.column(batch.schema.get_field_index("feature")).to_pylist():
                    if text is not None:
                        out.write((b",\n" if n else b"\n") + text.encode())
                        n += 1
            out.write(b"\n]}\n")
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, place = _folder(self.path)
        before = [] if self.overwrite else listed(self.path)
        now = [{"name": m.name, "features": m.features} for m in messages if m is not None and m.features]
        for m in messages:
            if m is not None and not m.features:  # nothing in it
                fs.delete_file(f"{place}/{m.name}")
        old = listed(self.path) if self.overwrite else []
        draft = f"{place}/.{LIST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"parts": before + now}).encode())
        fs.move(draft, f"{place}/{LIST}")
        for part in old:
            fs.delete_file(f"{place}/{part['name']}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, place = _folder(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{place}/{m.name}")


class GeoJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lanegraph_geojson"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema, overwrite: bool) -> Writer:
        if "feature" not in schema.fieldNames():
            raise ValueError("a column named feature is needed")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoJson)


def listed(path: str) -> list[dict]:
    """Names and numbers of features of the parts that belong to the result."""
    fs, place = _folder(path)
    if fs.get_file_info(f"{place}/{LIST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{place}/{LIST}") as f:
        return json.loads(f.read())["parts"]


def features_of(collections: DataFrame, column: str) -> DataFrame:
    """feature: each feature, as text, of a column of FeatureCollections; a collection without any, or null, gives none."""
    kind = "struct<features:array<string>>"
    return collections.select(F.explode(F.from_json(column, kind)["features"]).alias("feature"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature: every feature of the listed parts, a part at a time on the executors."""
    names = [f"{path.rstrip('/')}/{p['name']}" for p in listed(path)]
    if not names:
        return spark.createDataFrame([], "feature string")
    return features_of(spark.read.text(names, wholetext=True), "value")
