"""Names of communities: cached by content, by a given function, or by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def restore_names(communities: DataFrame, cache: DataFrame) -> DataFrame:
    """`communities` (content_hash, name) with the names that were given to the same members before."""
    known = cache.select("content_hash", F.col("name").alias("_name"), F.col("named_by").alias("_by"))
    joined = communities.join(known, "content_hash", "left")
    return joined.withColumn("name", F.coalesce("_name", "name")).withColumn("named_by", F.coalesce("_by", F.lit("heuristic"))).drop("_name", "_by")


def snapshot(members: DataFrame, nodes: DataFrame, degree: DataFrame, community: int) -> dict:
    """What a community looks like to someone who names it: up to 12 symbols, 8 files and its top directory."""
    own = members.where(F.col("community") == community).join(nodes, "id").join(degree.select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(36).select("name", "kind", "file").collect()
    files = list(dict.fromkeys(r.file for r in own if r.file))
    tops = [f.split("/")[0] if "/" in f else "(root)" for f in files]
    return {"symbols": [(r.name, r.kind) for r in own[:12]], "files": files[:8], "top": max(sorted(set(tops)), key=tops.count) if tops else "(external)"}


def name_communities(snapshots: dict[int, dict], ask: Callable[[dict], str] | None) -> dict[int, tuple[str, str]]:
    """Name and by whom: what `ask` says, up to 40 letters, or top directory and first symbol where it fails or is missing."""
    out = {}
    for community, s in snapshots.items():
        try:
            said = (ask(s) if ask else "").strip()[:40]
        except Exception:  # a model that fails must not stop the run
            said = ""
        first = s["symbols"][0][0] if s["symbols"] else "?"
        out[community] = (said, "llm") if said else (f"{s['top']} · {first}", "heuristic")
    return out


def architecture_summary(communities: DataFrame, gods: DataFrame, cycles: DataFrame) -> str:
    """A paragraph over the 12 largest communities, 8 hubs and 3 largest cycles."""
    parts = [f"{r['name']} ({r['size']})" for r in communities.orderBy(F.desc("size"), "community").limit(12).collect()]
    hubs = [r["name"] for r in gods.orderBy(F.desc("degree"), "id").limit(8).collect()]
    sizes = [str(r["size"]) for r in cycles.orderBy(F.desc("size")).limit(3).collect()]
    return f"Communities: {', '.join(parts) or 'none'}. Hubs: {', '.join(hubs) or 'none'}. Import cycles of sizes: {', '.join(sizes) or 'none'}."
