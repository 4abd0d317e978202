"""Ports and manifest, both JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph import schemas
from lanegraph.operators.ports import valid_ports
from lanegraph.sources.binary import ArtifactError, read_bytes

# Fixed values of the compact form.
COMPACT_SCHEMA = "ocean_ports_runtime"
COMPACT_VERSION = 2
#: Sections and keys of the manifest for each side artifact, in lower case.
SIDE_ARTIFACTS = {
    "edge_portals": ("edgeportals", {"edge_count": "edgecount"}),
    "corridor_hints": ("aiscorridorhints", {"hint_count": "hintcount"}),
    "land_mask": ("landmask", {"width": "width", "height": "height"}),
}


def json_value(text: Column, kind: str) -> Column:
    """A value given as JSON text as a column of type ``kind``; null if it is missing, null or of another kind."""
    text = F.when(text != "null", text)
    if kind == "string":
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)


def compact_ports(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Port records from positional rows (``row`` array<string>, each value as JSON text); missing, short and null values are null."""
    place = {name: i for i, name in enumerate(fields)}
    none = F.lit(None).cast("string")
    return rows.select(*[json_value(F.get("row", F.lit(place[n])) if n in place else none, k).alias(n) for n, k in schemas.PORT_FIELDS.items()])


def parse_ports(spark: SparkSession, text: str) -> DataFrame:
    """All records of a ports document in file order: an array of objects, or the compact form with its fields named once."""
    root = json.loads(text)
    if isinstance(root, list):
        lower = [{k.lower(): v for k, v in r.items()} for r in root]
        rows = [[json.dumps(r.get(n)) for n in schemas.PORT_FIELDS] for r in lower]
        fields = list(schemas.PORT_FIELDS)
    elif isinstance(root, dict):
        if root.get("schema") != COMPACT_SCHEMA or root.get("schemaVersion") != COMPACT_VERSION:
            raise ArtifactError("ports document has an unknown schema")
        fields, listed = root.get("fields"), root.get("ports")
        if not isinstance(fields, list) or not isinstance(listed, list) or not all(isinstance(r, list) for r in listed):
            raise ArtifactError("compact ports document lacks its fields or rows")
        rows = [[json.dumps(v) for v in r] for r in listed]
    else:
        raise ArtifactError("ports document is neither an array nor an object")
    return compact_ports(spark.createDataFrame([(r,) for r in rows], "row array<string>"), fields)


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """Valid ports of a file; there are a few hundred, so the document is read on the driver."""
    return valid_ports(parse_ports(spark, read_bytes(spark, path).decode("utf-8-sig")))


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest with lower-case keys at every level."""

    def low(x):
        if isinstance(x, dict):
            return {k.lower(): low(v) for k, v in x.items()}
        return [low(v) for v in x] if isinstance(x, list) else x

    found = low(json.loads(read_bytes(spark, path).decode("utf-8-sig")))
    if not isinstance(found, dict):
        raise ArtifactError("manifest is not an object")
    return found


def side_artifact_errors(manifest: dict, found: dict[str, dict]) -> list[str]:
    """What a manifest (lower-case keys) says of the side artifacts and what was found differ in; what it is silent on is not compared.

    ``found`` has what was read: ``edge_portals`` (sha256, edge_count), ``corridor_hints`` (sha256, hint_count), ``land_mask``
    (sha256, width, height).
    """
    errors = []
    for name, (section, fields) in SIDE_ARTIFACTS.items():
        claimed, facts = manifest.get(section), found.get(name)
        if not isinstance(claimed, dict) or facts is None:
            continue
        for field, key in {"sha256": "sha256", **fields}.items():
            want, have = claimed.get(key), facts.get(field)
            same = str(want).lower() == str(have).lower() if field == "sha256" else want == have
            if want is not None and have is not None and not same:
                errors.append(f"{name}.{field}")
    return errors


def require_side_artifacts(manifest: dict, found: dict[str, dict]) -> None:
    errors = side_artifact_errors(manifest, found)
    if errors:
        raise ArtifactError("manifest and artifacts differ in " + ", ".join(errors))


MANIFEST_FIELDS = ("node_count", "edge_count", "resolution", "sha256")


def claim_errors(claimed: str = "m_", found: str = "", fields: tuple[str, ...] = MANIFEST_FIELDS) -> Column:
    """Array of the fields in which two sets of columns, told apart by their prefixes, differ; hashes are compared without regard to case."""
    fold = lambda c, f: F.lower(c) if f == "sha256" else F.col(c)
    return F.array_compact(F.array(*[F.when(fold(claimed + f, f) != fold(found + f, f), F.lit(f)) for f in fields]))


def manifest_errors(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """One row with ``errors``: the fields in which one-row tables of what is claimed and what was found differ."""
    both = manifest.select(*[F.col(c).alias(f"m_{c}") for c in MANIFEST_FIELDS]).crossJoin(F.broadcast(facts))  # one row each
    return both.select(claim_errors().alias("errors"))


def require_no_errors(errors: DataFrame) -> None:
    found = errors.first()["errors"]
    if found:
        raise ArtifactError("manifest and graph differ in " + ", ".join(found))
