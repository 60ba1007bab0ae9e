"""Machine-readable dumps of single documents, read for a whole corpus.

One file is one document, whose path is the ``doc_id``; or, packed by
:func:`quire.sources.sinks.write_dumps`, one row is one. Schemas are declared, so
no pass over the data infers them, and an absent key stays NULL while an empty
one stays empty.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.graph import Levels
from quire.session import WrittenRows, written

# The fields of each dump.
INDEX_SCHEMAS = {
    "objects": "objNum bigint, gen int, typeName string, free boolean, reachable boolean, nodeId string",
    "pages": (
        "pageNum bigint, objNum bigint, gen int, nodeId string, contentNodeId string, mediaBox array<double>, "
        "rotate int, inherited int, annotCount int, contentLen bigint, error string"
    ),
    "images": (
        "objNum bigint, gen int, nodeId string, firstPage bigint, pageCount bigint, firstPages array<bigint>, "
        "width bigint, height bigint, bitsPerComponent int, colorSpace string, filters array<string>, "
        "imageMask boolean, smask string, decode array<double>, decodeNonDefault boolean, sampleInterpretation string, "
        "adobeMarker string, adobeTransform int, estimatedBytes bigint, firstPageNodeIds array<string>, warning string, error string"
    ),
    "xref": "objNum bigint, gen int, status string, offset bigint, hostObjStm bigint, nodeID string",
    "signatures": (
        "fieldName string, fieldNodeId string, signed boolean, type string, subFilter string, signingTime string, "
        "signingTimeRaw string, coversWholeFile boolean, coverageError string"
    ),
    "embedded": (
        "name string, filespecRef string, embeddedFileRef string, afRelationship string, subtype string, "
        "size bigint, checkSum string, modDate string, warning string"
    ),
}
PACKED = "doc_id string, value string"
OPS = "op string, params array<string>, srcLineStart bigint, srcLineEnd bigint, resourceType string, objectRef string"


def read_index_dump(spark: SparkSession, kind: str, path: str, packed: bool = False) -> DataFrame:
    """Rows of a flat index dump: objects, pages, images, xref, signatures, embedded or metadata.

    A packed dump that can't be read is one row of nulls, like a file.
    """
    if kind == "metadata":
        rows = _documents(spark, path, "info map<string,string>, xmp string", packed)
        return rows.select("doc_id", "info", "xmp")
    schema = INDEX_SCHEMAS[kind]
    if kind == "xref":
        table = _documents(spark, path, f"entries array<struct<{_as_struct(schema)}>>", packed)
        return table.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")
    if not packed:
        return _documents(spark, path, schema, packed)
    listed = spark.read.schema(PACKED).parquet(path).select("doc_id", F.from_json("value", f"array<struct<{_as_struct(schema)}>>").alias("_l"))
    return listed.where("_l IS NULL OR size(_l) > 0").select("doc_id", F.explode_outer("_l").alias("e")).select("doc_id", "e.*")


def _documents(spark: SparkSession, path: str, schema: str, packed: bool) -> DataFrame:
    """``doc_id`` and the fields of each document."""
    if packed:
        return spark.read.schema(PACKED).parquet(path).select("doc_id", F.from_json("value", schema).alias("e")).select("doc_id", "e.*")
    read = spark.read.option("multiLine", True).schema(schema).json(path)
    return read.select(F.col("_metadata.file_path").alias("doc_id"), "*")


def _as_struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in _fields(schema)))


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited operators, splittable: ``doc_id`` and the fields of :data:`OPS`."""
    return spark.read.schema(OPS).json(path).select(F.col("_metadata.file_path").alias("doc_id"), "*")


# Fields of a tree node and their columns.
TREE_FIELDS = {
    "id": "id string", "label": "label string", "rawKey": "raw_key string", "nodeType": "node_type string",
    "valueType": "value_type string", "pdfRef": "pdf_ref string", "typeName": "type_name string",
    "value": "value string", "childCount": "child_count bigint",
}


def read_tree_dump(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Rows of nested tree dumps: ``doc_id, ord, depth`` and one column per field.

    A recursive schema cannot be declared, so nodes are VARIANT values and one
    level of children is exploded per step; ``ord`` is the path of child
    positions. A level is written out before the next, without the children.
    """
    if packed:
        text = spark.read.schema(PACKED).parquet(path)
    else:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    raw = text.select("doc_id", F.parse_json("value").alias("node"))
    current = WrittenRows.write(raw.select("doc_id", "node", F.array().cast("array<bigint>").alias("ord")))
    fields = []
    for f, col in TREE_FIELDS.items():
        name, kind = col.split(" ")
        fields.append(F.try_variant_get("node", f"$.{f}", kind).alias(name))
    out: Levels | None = None
    for depth in itertools.count():
        rows = written(current.df.select("doc_id", "ord", F.lit(depth).alias("depth"), *fields))
        if out is None:
            out = Levels(rows)
        else:
            out.add(rows)
        kids = current.df.withColumn("_kids", F.try_variant_get("node", "$.children", "array<variant>")).select(
            "doc_id", "ord", F.posexplode("_kids").alias("_i", "node"))
        below = WrittenRows.write(kids.select("doc_id", "node", F.array_append("ord", F.col("_i").cast("bigint")).alias("ord")))
        current.drop()
        current = below
        if current.df.isEmpty():
            break
    current.drop()
    return out.all()
