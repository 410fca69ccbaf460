"""Reference resolution: a ladder of rules as equi-joins on indexes that were summed before.

The first rule that applies decides: members of the own class, names of the same file, names of imported files,
builtins, names from outside, and names that exactly one sibling file defines. Where several symbols fit, the one of
smallest place or id is taken and the reference is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..extract.builtins import builtin_table
from ..storage import dealt
from .build import symbols
from .imports import Resolved, alias_targets, dir_name, external_aliases, import_rows

RELATION = {"call": "calls", "extends": "extends", "implements": "implements", "instantiates": "instantiates", "type_uses": "type_uses"}


def reference_rows(extractions: DataFrame) -> DataFrame:
    """repo, path, language, at (the reference's place) and its fields."""
    return extractions.select("repo", "path", "language", F.posexplode("references").alias("at", "r")).select("repo", "path", "language", "at", "r.*").withColumnRenamed("kind", "ref_kind")


def resolve_references(extractions: DataFrame, resolved_imports: Resolved, found: DataFrame | None = None) -> DataFrame:
    """Every reference with target, confidence and outcome (extracted, inferred, ambiguous, dropped or unresolved); `found` are the repositories' symbols, if there are others than in `extractions`."""
    refs = reference_rows(extractions)
    found = symbols(extractions) if found is None else found
    imports = import_rows(extractions)
    key = ["repo", "path", "at"]
    # Members of the own class.
    enclosing = F.when(F.col("self_receiver") & F.col("scope").contains("."), F.regexp_replace("scope", r"\.[^.]*$", ""))
    tail = F.regexp_replace("id", "^[^#]*#", "")
    own = refs.withColumn("enclosing", enclosing).where("enclosing is not null").join(found.select("repo", "path", "name", "id", "seq"), ["repo", "path", "name"])
    members = own.where(F.contains(tail, F.concat("enclosing", F.lit(".")))).groupBy(*key).agg(F.count("*").alias("n1"), F.min_by("id", "seq").alias("t1"))
    # Names of the same file.
    by_name = found.groupBy("repo", "path", "name").agg(F.count("*").alias("n2"), F.min_by("id", "seq").alias("t2"))
    # Names of imported files: by the receiver, else by its head, else by all imports. One row for each (file, receiver, name).
    targets, packages = alias_targets(imports, resolved_imports)
    asked = refs.select("repo", "path", "name", F.coalesce("receiver", F.lit("")).alias("told")).distinct()
    head = F.substring_index("told", ".", 1)
    tries = asked.select("repo", "path", "name", "told", F.posexplode(F.array(F.when(F.col("told") != "", F.col("told")), F.when(F.col("told").contains("."), head), F.lit(""))).alias("turn", "alias")).where("alias is not null")
    meant = targets.select("repo", "path", "alias").unionByName(packages.select("repo", "path", "alias")).distinct()
    known = tries.join(meant, ["repo", "path", "alias"], "left_semi")
    chosen = known.groupBy("repo", "path", "name", "told").agg(F.min_by("alias", "turn").alias("alias"))
    imported = chosen.join(targets, ["repo", "path", "alias"]).join(found.select("repo", F.col("path").alias("target"), "name", "id"), ["repo", "target", "name"])
    # A package is met by its directory and the name, never file by file.
    held = found.select("repo", dir_name(F.col("path")).alias("dir"), F.col("path").alias("target"), "name", "id")
    by_package = chosen.join(packages, ["repo", "path", "alias"]).join(held, ["repo", "dir", "name"]).where("own or path != target")
    imported = imported.select("repo", "path", "name", "told", "id").unionByName(by_package.select("repo", "path", "name", "told", "id")).distinct()
    imported = imported.groupBy("repo", "path", "name", "told").agg(F.count("*").alias("n3"), F.min("id").alias("t3"))
    # Names that one sibling alone defines, once.
    lone = found.groupBy("repo", "name").agg(F.count_distinct("path").alias("files"), F.count("*").alias("times"), F.min("path").alias("target"), F.min("id").alias("t8")).where("files = 1 and times = 1")
    lone = lone.select(F.col("repo").alias("lone_repo"), F.col("name").alias("lone"), "t8", F.col("target").alias("lone_path"), dir_name(F.col("target")).alias("lone_dir"))
    # A few hundred fixed rows.
    builtins = F.broadcast(builtin_table(extractions.sparkSession))
    outside = external_aliases(imports, resolved_imports)
    rows = refs.withColumn("told", F.coalesce("receiver", F.lit(""))).withColumn("word", F.when(F.col("told") == "", F.col("name")).otherwise(F.substring_index("told", ".", 1)))
    rows = rows.join(members, key, "left").join(by_name, ["repo", "path", "name"], "left").join(imported, ["repo", "path", "name", "told"], "left")
    rows = rows.join(builtins.select("language", F.col("name").alias("word"), F.lit(True).alias("builtin")), ["language", "word"], "left")
    rows = rows.join(outside.select("repo", "path", F.col("alias").alias("told"), F.lit(True).alias("outside")), ["repo", "path", "told"], "left")
    # References of a common name are many; the name is one row here, with a shuffle of its own.
    rows = rows.join(lone, dealt("repo", "name") == dealt("lone_repo", "lone"), "left")
    sibling = (F.col("lone_dir") == dir_name(F.col("path"))) & (F.col("lone_path") != F.col("path"))
    bare = F.col("told") == ""

    def step(target, outcome):
        return F.struct(target.alias("target"), F.lit(outcome).alias("outcome"))

    none = F.lit(None).cast("string")
    ladder = (
        F.when(F.col("self_receiver") & (F.col("n1") == 1), step(F.col("t1"), "extracted"))
        .when(F.col("self_receiver") & (F.col("n1") > 1), step(F.col("t1"), "ambiguous"))
        .when(F.col("self_receiver"), step(none, "dropped"))
        .when(F.col("n2") == 1, step(F.col("t2"), "extracted")).when(F.col("n2") > 1, step(F.col("t2"), "ambiguous"))
        .when(F.col("n3") == 1, step(F.col("t3"), "inferred")).when(F.col("n3") > 1, step(F.col("t3"), "ambiguous"))
        .when(F.col("builtin"), step(none, "dropped"))
        .when(~bare & F.col("outside"), step(F.concat(F.lit("ext:"), "told", F.lit("."), "name"), "inferred"))
        .when(~bare, step(none, "unresolved"))
        .when(F.col("t8").isNotNull() & sibling, step(F.col("t8"), "inferred"))
        .otherwise(step(none, "unresolved"))
    )
    out = rows.withColumn("found", ladder)
    return out.select("repo", "path", "language", "at", "name", "ref_kind", "start", "end", "scope", "receiver", F.col("found.target").alias("target"), F.col("found.outcome").alias("outcome"))


def reference_edges(resolved: DataFrame, extractions: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Edges of resolved references, from the symbol whose scope they stand in or else from the file; names outside are kept for calls only."""
    scopes = (symbols(extractions) if found is None else found).groupBy("repo", "path", F.col("qualified").alias("scope")).agg(F.max_by("id", "seq").alias("holder"))
    kept = resolved.where(F.col("target").isNotNull() & ((F.col("ref_kind") == "call") | ~F.col("target").startswith("ext:")))
    relation = F.element_at(F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair]), F.col("ref_kind"))
    return kept.join(scopes, ["repo", "path", "scope"], "left").select(
        "repo", F.coalesce("holder", F.concat(F.lit("file:"), "path")).alias("src"), F.col("target").alias("dst"), relation.alias("relation"), F.upper("outcome").alias("confidence"),
        F.col("path").alias("file"), F.col("start.row").cast("bigint").alias("sl"), F.col("start.col").cast("bigint").alias("sc"), F.col("end.row").cast("bigint").alias("el"), F.col("end.col").cast("bigint").alias("ec"), "at",
    )


def call_stats(refs: DataFrame) -> DataFrame:
    """One row over references (ref_kind, outcome): how calls were resolved, and the rate of those that could be."""
    names = ("extracted", "inferred", "ambiguous", "dropped", "unresolved")
    own = refs.where("ref_kind = 'call'").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    known = F.col("total") - F.col("dropped")
    return own.withColumn("rate", F.when(known > 0, F.round((F.col("extracted") + F.col("inferred")) / known, 4)))
