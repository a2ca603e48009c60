"""Tables of the project graph: schemas, closed vocabularies and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    """From ``name KIND, ...``, without a session."""
    return T.StructType([T.StructField(n.strip("`"), _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


NODES = _struct(
    "id STRING, kind STRING, label STRING, body STRING, file STRING, line INT, `end` INT, "
    "files ARRAY<STRING>, community STRING"
)
EDGES = _struct("source STRING, target STRING, kind STRING, context STRING, file STRING")
MANIFEST = _struct("rel STRING, kind STRING, hash STRING, mtime_ns LONG, len LONG")
POSTINGS = _struct("idx STRING, gram STRING, key STRING, id STRING, tf INT")
VECTORS = _struct("id STRING, row_no INT, row_hash STRING, model STRING, dim INT, embedding ARRAY<FLOAT>")
EDGE_KEY = ["source", "target", "kind", "context", "file"]
#: What extraction semantics a manifest was written under; 0 asks for a full re-read.
GRAMMAR = 6

# The closed vocabularies, edges in their sort order.
NODE_KINDS = ["Requirement", "Entity", "Invariant", "Adr", "Milestone", "Task", "File", "Symbol", "LegacyConcept", "Text"]
EDGE_KINDS = ["References", "Declares", "Links", "Implements", "Imports", "ReExports", "Calls", "Extends", "DecoratedBy", "Legacy"]
FILE_KINDS = ["Doc", "Code", "Registry", "Text"]
#: Kinds of code, as against documents.
CODE_KINDS = ["File", "Symbol"]


def edge_rank(kind: str = "kind") -> Column:
    """Position of an edge kind in its sort order, as a column."""
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), F.col(kind))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``table, id, why`` of rows outside the closed vocabularies or without an id."""
    bad_node = F.when(F.col("id").isNull() | (F.col("id") == ""), "no id").when(
        ~F.coalesce(F.col("kind").isin(NODE_KINDS), F.lit(False)), "kind"
    )
    bad_edge = F.when(F.col("source").isNull() | F.col("target").isNull(), "no end").when(
        ~F.coalesce(F.col("kind").isin(EDGE_KINDS), F.lit(False)), "kind"
    )
    a = nodes.select(F.lit("nodes").alias("table"), "id", bad_node.alias("why"))
    b = edges.select(F.lit("edges").alias("table"), F.col("source").alias("id"), bad_edge.alias("why"))
    return a.unionByName(b).where("why is not null")
