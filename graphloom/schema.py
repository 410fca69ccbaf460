"""Vocabularies and table schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The vocabularies of the graph.
NODE_KINDS = ("repo", "dir", "file", "module", "package", "class", "interface", "struct", "enum", "trait", "function", "method", "variable", "constant", "type", "route", "test", "external", "community")
RELATIONS = ("contains", "defines", "imports", "calls", "extends", "implements", "instantiates", "references", "type_uses", "tests", "exposes", "returns")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
JOB_STATES = ("queued", "running", "done", "error")
JOB_PHASES = ("resolve", "clone", "walk", "parse", "extract", "build", "analyze", "name", "done")
#: Kinds that analytics leave out.
STRUCTURAL_KINDS = ("repo", "dir", "file", "external", "community")
#: Weights of the relations that tie symbols together, for communities.
RELATION_WEIGHTS = {"calls": 2.0, "extends": 2.0, "implements": 2.0, "instantiates": 1.5, "type_uses": 1.0, "contains": 1.0}
#: Relations along which a change of a symbol reaches others.
IMPACT_RELATIONS = ("calls", "instantiates", "extends", "implements", "imports", "type_uses")

NODES = "repo string, id string, kind string, name string, qualified string, file string, sl int, sc int, el int, ec int, language string, doc string"
EDGES = "seq bigint, repo string, src string, dst string, relation string, confidence string, file string, sl bigint, sc bigint, el bigint, ec bigint"
FILES = "repo string, path string, language string, size bigint, loc bigint, sha256 string, mtime timestamp"
POINT = "struct<row:int,col:int>"
SYMBOL = f"struct<kind:string,name:string,qualified:string,start:{POINT},end:{POINT},parent:string,doc:string,ordinal:int>"
REFERENCE = f"struct<name:string,kind:string,start:{POINT},end:{POINT},scope:string,receiver:string,full:string,self_receiver:boolean>"
IMPORT = f"struct<module:string,start:{POINT},end:{POINT},names:array<string>,alias:string,level:int>"
EXTRACTION = f"repo string, path string, language string, symbols array<{SYMBOL}>, references array<{REFERENCE}>, imports array<{IMPORT}>, errors array<string>, parse_ok boolean, error string, node_count bigint, error_count bigint, missing_count bigint"


def structural(kind: Column) -> Column:
    return kind.isin(*STRUCTURAL_KINDS)


def unknown_vocabulary(nodes, edges):
    """Rows of kinds, relations or confidences outside the vocabularies: (what, value)."""
    bad_kind = nodes.where(~F.col("kind").isin(*NODE_KINDS)).select(F.lit("kind").alias("what"), F.col("kind").alias("value"))
    bad_relation = edges.where(~F.col("relation").isin(*RELATIONS)).select(F.lit("relation").alias("what"), F.col("relation").alias("value"))
    bad_confidence = edges.where(~F.col("confidence").isin(*CONFIDENCES)).select(F.lit("confidence").alias("what"), F.col("confidence").alias("value"))
    return bad_kind.unionByName(bad_relation).unionByName(bad_confidence).distinct()
