"""Traversals: frontiers meet edges hop by hop, never a path enumeration.

A graph that is walked more than once is stored as `Stored`: every edge twice, in folders by each of its ends. A walk
over it reads the folders of its frontier alone. Frontiers of up to HELD ids are lists on the driver, which go into the
filters of the next read; larger ones are tables in the shared folder, joined with the folders that they touch. The
functions below take a stored graph or a frame of edges; of the latter, they write what a walk may take and join that.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..schema import IMPACT_RELATIONS
from ..storage import Buckets, cut, small

#: Ids of a frontier that the driver holds; a larger one is a table.
HELD = 5_000


def allowed(edges: DataFrame, relations=None, confidences=None) -> DataFrame:
    """The edges that a walk may take; names in any case, none means all."""
    if relations:
        edges = edges.where(F.lower("relation").isin(*[r.lower() for r in relations]))
    if confidences:
        edges = edges.where(F.upper("confidence").isin(*[c.upper() for c in confidences]))
    return edges.where("src != dst")


class Stored:
    """The edges of one graph, in folders by source and by target; either side is written when a walk first needs it."""

    def __init__(self, edges: DataFrame, n: int = 32):
        self.given, self.n = edges, n

    @classmethod
    def write(cls, edges: DataFrame, n: int = 32) -> Stored:
        """Both sides, at once."""
        own = cls(edges, n)
        own.out, own.into  # noqa: B018
        return own

    @cached_property
    def out(self) -> Buckets:
        return Buckets.write(self.given, "src", "edges-out", self.n)

    @cached_property
    def into(self) -> Buckets:
        return Buckets.write(self.edges, "dst", "edges-in", self.n)

    @property
    def written(self) -> list[Buckets]:
        """The sides that stand."""
        return [vars(self)[side] for side in ("out", "into") if side in vars(self)]

    @property
    def edges(self) -> DataFrame:
        """All edges: from the folders where they stand, otherwise as they were given."""
        return self.written[0].rows if self.written else self.given

    def steps(self, frontier: list[str] | DataFrame, direction: str = "both", relations=None, confidences=None) -> DataFrame:
        """(at, to) of the edges that lead away from a frontier."""
        parts = []
        for side, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
            if direction in (side, "both"):
                table = self.out if side == "out" else self.into
                rows = table.of(frontier) if isinstance(frontier, list) else table.matching(frontier)
                parts.append(allowed(rows, relations, confidences).select(F.col(own).alias("at"), F.col(other).alias("to")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def touching(self, node: str) -> tuple[DataFrame, DataFrame]:
        """The edges into and out of one node."""
        return self.into.of([node]), self.out.of([node])

    def drop(self) -> None:
        for side in self.written:
            side.drop()


def walked(stored: Stored, start: list[str], depth: int, direction: str, relations, confidences) -> DataFrame:
    """id and hop of everything within `depth` hops. The last hop is not run but returned as a plan; those before run one job each."""
    spark = stored.given.sparkSession
    hops: dict[str, int] = dict.fromkeys(start, 0)
    frontier: list[str] | DataFrame = start
    seen: DataFrame | None = None  # once a frontier is too large to be held
    held = lambda: small(spark, list(hops.items()), "id string, hop int")
    for hop in range(1, depth + 1):
        reached = stored.steps(frontier, direction, relations, confidences).select(F.col("to").alias("id")).distinct()
        before = held() if seen is None else seen
        new = reached.join(before.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop == depth:
            return before.unionByName(new)
        if seen is None:
            some = [r["id"] for r in new.limit(HELD + 1).collect()]
            if len(some) <= HELD:
                hops |= dict.fromkeys(some, hop)
                frontier = some
            else:
                frontier = cut(new, "frontier")
                seen = before.unionByName(frontier)
        else:
            frontier = cut(new, "frontier")
            seen = seen.unionByName(frontier)
        if not frontier if isinstance(frontier, list) else frontier.isEmpty():
            break
    return held() if seen is None else seen


def adjacency(edges: DataFrame, direction: str = "both", relations=None, confidences=None) -> DataFrame:
    """(at, to) of the edges that a walk may take, as often as they are there."""
    own = allowed(edges, relations, confidences)
    out, back = own.select(F.col("src").alias("at"), F.col("dst").alias("to")), own.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def bfs(edges: DataFrame | Stored, start: list[str], depth: int, direction: str = "both", relations=None, limit: int | None = None, confidences=None) -> DataFrame:
    """id and hop of everything within `depth` hops; with `limit`, the first so many in (hop, id) order.

    Only what a frontier reaches is made distinct, never all edges. Over a frame of edges, a walk of several hops writes
    the ends of the edges that it may take once.
    """
    spark = edges.given.sparkSession if isinstance(edges, Stored) else edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in start], "id string, hop int")
    if depth < 1 or not start:
        return seen.orderBy("hop", "id").limit(limit) if limit else seen
    if isinstance(edges, Stored):
        seen = walked(edges, list(dict.fromkeys(start)), depth, direction, relations, confidences)
        return seen.orderBy("hop", "id").limit(limit) if limit else seen
    steps = adjacency(edges, direction, relations, confidences)
    steps = cut(steps, "steps") if depth > 1 else steps
    frontier = None
    for hop in range(1, depth + 1):
        reached = steps.where(F.col("at").isin(*start)) if frontier is None else steps.join(frontier.select(F.col("id").alias("at")), "at", "left_semi")
        reached = reached.select(F.col("to").alias("id")).distinct()
        new = (reached.where(~F.col("id").isin(*start)) if frontier is None else reached.join(seen.select("id"), "id", "left_anti")).withColumn("hop", F.lit(hop))
        if hop < depth:
            new = cut(new, "frontier")
            if new.isEmpty():
                break
        seen, frontier = seen.unionByName(new), new
    return seen.orderBy("hop", "id").limit(limit) if limit else seen


def with_nodes(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes reached, with their hop."""
    return nodes.join(hops, "id")


def induced(edges: DataFrame | Stored, ids: DataFrame) -> DataFrame:
    """Edges with both ends among `ids` (id)."""
    if isinstance(edges, Stored):
        some = [r["id"] for r in ids.select("id").where("id is not null").distinct().limit(HELD + 1).collect()]
        if len(some) <= HELD:
            return edges.out.of(some).where(F.col("dst").isin(*some))
        return edges.out.matching(ids.select("id")).join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.out.schema.names)
    own = ids.select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbors(nodes: DataFrame, edges: DataFrame | Stored, node: str, depth: int = 2, direction: str = "both", relations=None, limit: int = 400) -> DataFrame:
    return with_nodes(bfs(edges, [node], depth, direction, relations, limit), nodes)


def callers(nodes: DataFrame, edges: DataFrame | Stored, node: str) -> DataFrame:
    return neighbors(nodes, edges, node, 1, "in", ("calls",))


def callees(nodes: DataFrame, edges: DataFrame | Stored, node: str) -> DataFrame:
    return neighbors(nodes, edges, node, 1, "out", ("calls",))


def module_dependencies(nodes: DataFrame, edges: DataFrame | Stored, file: str) -> DataFrame:
    return neighbors(nodes, edges, f"file:{file}", 1, "both", ("imports",), 200)


def impact(edges: DataFrame | Stored, node: str, depth: int = 3, limit: int = 3000, relations=IMPACT_RELATIONS) -> DataFrame:
    """What a change of `node` reaches: everything that comes to it within `depth` hops."""
    return bfs(edges, [node], depth, "in", relations, limit)


def impact_files(hops: DataFrame, nodes: DataFrame, root: str, limit: int = 200) -> DataFrame:
    """file and n of what is reached, without the root."""
    own = with_nodes(hops.where(F.col("id") != root), nodes).where("file is not null")
    return own.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(limit)


def focus_graph(nodes: DataFrame, edges: DataFrame | Stored, focus: str, depth: int = 2, limit: int = 1500, kinds=None, relations=None) -> tuple[DataFrame, DataFrame]:
    """The nodes around a focus and the edges among them; the focus stays whatever the kinds."""
    own = neighbors(nodes, edges, focus, depth, "both", relations, max(limit, 200))
    if kinds:
        own = own.where(F.col("kind").isin(*kinds) | (F.col("id") == focus))
    among = induced(edges, own)
    return own, among.where(F.col("relation").isin(*relations)) if relations else among


class Side:
    """One end of a search from both: its levels, and of each id which ids of the next level follow."""

    def __init__(self, root: str):
        self.levels: list[set[str]] = [{root}]
        self.seen = {root}
        self.after: dict[str, set[str]] = defaultdict(set)

    def grow(self, stored: Stored, relations) -> bool:
        """Finds the next level; False if that is more than the driver holds."""
        pairs = stored.steps(sorted(self.levels[-1]), "both", relations).distinct().limit(4 * HELD + 1).collect()
        if len(pairs) > 4 * HELD:
            return False
        self.levels.append({r["to"] for r in pairs} - self.seen)
        self.seen |= self.levels[-1]
        for r in pairs:
            if r["to"] in self.levels[-1]:
                self.after[r["at"]].add(r["to"])
        return True


def met_path(stored: Stored, start: str, goal: str, most: int, relations) -> list[str] | None:
    """A shortest path by two searches, of which the smaller grows; they meet on the level where the path's length is known. [] if there is none, None if a level is too large to be held."""
    near, far = Side(start), Side(goal)
    while not (meet := near.levels[-1] & far.levels[-1]):
        if len(near.levels) + len(far.levels) - 2 == most or not near.levels[-1] or not far.levels[-1]:
            return []
        if not min((near, far), key=lambda s: len(s.levels[-1])).grow(stored, relations):
            return None
    # Of the far levels, what lies on a shortest path; from the goal, always the smallest id of the next level.
    on_path = [meet]
    for level in reversed(far.levels[:-1]):
        on_path.append({x for x in level if far.after[x] & on_path[-1]})
    path = [goal]
    for level in reversed(on_path[:-1]):
        path.append(min(far.after[path[-1]] & level))
    for level in reversed(near.levels[:-1]):
        path.append(min(x for x in level if path[-1] in near.after[x]))
    return path[::-1]


def shortest_path(edges: DataFrame | Stored, start: str, goal: str, most: int = 6, relations=None) -> DataFrame:
    """hop and id along a shortest undirected path; of several, the one whose steps back from the goal have smallest ids. Empty if there is none.

    Over a stored graph the search goes from both ends, and reads what their frontiers touch; where these outgrow the
    driver, and over a frame of edges, it goes forward by tables.
    """
    if isinstance(edges, Stored):
        path = met_path(edges, start, goal, most, relations)
        if path is not None:
            return edges.given.sparkSession.createDataFrame(list(enumerate(path)), "hop int, id string")
        edges = edges.edges
    spark = edges.sparkSession
    steps = cut(adjacency(edges, "both", relations), "steps")
    levels = [spark.createDataFrame([(start, None)], "id string, via string")]
    seen, found = levels[0].select("id"), start == goal
    for _ in range(most):
        if found:
            break
        reached = levels[-1].select(F.col("id").alias("via")).join(steps, F.col("via") == F.col("at")).groupBy(F.col("to").alias("id")).agg(F.min("via").alias("via"))
        new = cut(reached.join(seen, "id", "left_anti"), "frontier")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("id"))
        found = not new.where(F.col("id") == goal).isEmpty()
    if not found:
        return spark.createDataFrame([], "hop int, id string")
    path = [goal]
    for level in reversed(levels[1:]):  # one row a hop
        path.append(level.where(F.col("id") == path[-1]).first()["via"])
    return spark.createDataFrame([(i, x) for i, x in enumerate(reversed(path))], "hop int, id string")
