"""Graph analytics: communities, cycles, hubs, orphans and what crosses communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import RELATION_WEIGHTS, structural
from ..storage import cut, dealt, drop, numbered, placed


def weighed(edges: DataFrame) -> DataFrame:
    """src, dst, w and seq of the edges that tie two different ends."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair]), F.col("relation"))
    return edges.where(F.col("relation").isin(*RELATION_WEIGHTS) & (F.col("src") != F.col("dst"))).select("src", "dst", weight.alias("w"), "seq")


def last_ties(ties: DataFrame) -> DataFrame:
    """The last of the ties (a, b, w, seq) of each pair."""
    # Nearly every tie is a pair of its own, so summing what a file's block has holds all of it in a task. Ties are dealt
    # out by pair first, in lots of Spark's size; by a struct, so that a pair of very many ties may be split and is summed twice.
    return ties.withColumn("pair", dealt("a", "b")).hint("rebalance", "pair").groupBy("a", "b").agg(F.max_by("w", F.struct("seq", "w")).alias("w"))


def symbol_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a < b and w: one undirected edge between two symbols, of the weight of their last tie."""
    own = nodes.where(~structural(F.col("kind"))).select("id")
    ties = weighed(edges).join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return last_ties(ties.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w", "seq"))


def numbered_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id and n: every symbol and its number, in the order of ids; and `symbol_subgraph` between numbers.

    Names are met once for each end of an edge, which tells symbols from others too; pairs are summed by numbers.
    """
    numbers = cut(placed(nodes.where(~structural(F.col("kind"))).select("id").distinct(), ["id"], "n"), "numbers")
    at = lambda end: numbers.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"))
    ties = weighed(edges).join(at("src"), "src").join(at("dst"), "dst")
    return numbers, cut(last_ties(ties.select(F.least("src_n", "dst_n").alias("a"), F.greatest("src_n", "dst_n").alias("b"), "w", "seq")), "ties")


def both_ways(ties: DataFrame) -> DataFrame:
    return ties.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(ties.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def modularity(ties: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """The share of ties inside communities, less what chance would give; 0 without ties."""
    return quality(contracted(ties, labels), resolution)


def quality(above: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of communities, of the ties between them and their loops (a, b, w)."""
    ends = above.select(F.explode(F.array("a", "b")).alias("label"), "w", F.when(F.col("a") == F.col("b"), F.col("w") / 2).otherwise(0.0).alias("inside"))
    sums = ends.groupBy("label").agg(F.sum("w").alias("k"), F.sum("inside").alias("inside"))
    inside, twice, squares = sums.agg(F.sum("inside"), F.sum("k"), F.sum(F.col("k") * F.col("k"))).first()
    return 2 * inside / twice - resolution * squares / twice**2 if twice else 0.0


def local_moves(ties: DataFrame, resolution: float, gain: float = 1e-6, start: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """One level of modularity moves, from `start` (id, label) or from each node alone: id and label.

    Each round half of the nodes, by a hash that changes with the round, may move to the neighbour community of most
    gain. Rounds go on while two of them together raise the modularity by `gain`, so they end; the best labels are
    returned. `above` are the ties contracted to `start`, if they are known.
    """
    links = cut(both_ways(ties.select("a", "b", "w")), "links")
    strength = cut(links.groupBy("u").agg(F.sum("w").alias("k")), "strength")
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    labels = cut(strength.select(F.col("u").alias("id"), F.col("u").alias("label")) if start is None else start.select("id", "label"), "labels")
    best, best_labels, turn = modularity(ties, labels, resolution) if above is None else quality(above, resolution), labels, 0
    while True:
        mine = F.pmod(F.xxhash64("u", F.lit(turn // 2)), F.lit(2)) == turn % 2
        weighed_ = labels.join(strength, F.col("id") == F.col("u")).select("id", "label", "k")
        mass = weighed_.groupBy("label").agg(F.sum("k").alias("mass"), F.count("*").alias("held"))
        near = links.where(mine & (F.col("u") != F.col("v"))).join(labels.select(F.col("id").alias("v"), F.col("label").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").alias("w"))
        own = weighed_.select(F.col("id").alias("u"), "label", "k").where(mine)
        # The largest community is near to many; its sum is one row, with a shuffle of its own.
        gains = near.join(own, "u").join(mass.withColumnRenamed("label", "of"), dealt("to") == dealt("of"))
        # Two that are alone would change places for ever; only the one of larger label goes.
        gains = gains.where((F.col("to") <= F.col("label")) | (F.col("held") > 1))
        rest = F.col("mass") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0)
        gains = gains.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / total, 9))
        top = gains.groupBy("u").agg(F.max(F.struct("gain", (F.col("to") == F.col("label")).alias("stay"), "to")).alias("best"), F.max(F.when(F.col("to") == F.col("label"), F.col("gain"))).alias("here"))
        moves = F.coalesce((F.col("best.gain") > F.coalesce("here", F.lit(0.0))) & ~F.col("best.stay"), F.lit(False))
        new = cut(labels.join(top, F.col("id") == F.col("u"), "left").select("id", F.when(moves, F.col("best.to")).otherwise(F.col("label")).alias("label")), "labels")
        if labels is not best_labels:
            drop(labels)
        labels, turn = new, turn + 1
        if turn % 2:
            continue
        now = modularity(ties, labels, resolution)
        if now < best + gain:
            break
        drop(best_labels)
        best, best_labels = now, labels
    if labels is not best_labels:
        drop(labels)
    for used in (links, strength):
        drop(used)
    return best_labels


def contracted(ties: DataFrame, to: DataFrame) -> DataFrame:
    """Ties (a, b, w) between the groups that `to` (id, label) gives their ends; those inside a group are loops of it."""
    named = lambda end: to.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    joined = ties.join(named("a"), "a").join(named("b"), "b")
    return joined.groupBy(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).agg(F.sum("w").alias("w"))


def agglomerated(ties: DataFrame, resolution: float) -> DataFrame:
    """id and label: groups that grow from single nodes (a, b: their numbers) while joining two of them raises the modularity.

    Each round every group wishes for the neighbour that it gains most with, ties by a hash of the pair. One that wishes
    for a stronger group is willing, and the willing go whose choice is not. Each chain of wishes ends in two groups that
    wish for each other, of which the weaker one goes, so every round joins some, and all that gains is joined at last.
    A round sees the ties between the groups that are left, which a round shrinks by the leaves of every hub.
    """
    labels, left = grown(ties, resolution)
    drop(left)
    return labels


def grown(ties: DataFrame, resolution: float) -> tuple[DataFrame, DataFrame]:
    """`agglomerated`, and the ties (a, b, w) between the groups.

    Ties bring the strengths of their ends (ka, kb) along, so that a round meets groups once, when it renames them.
    """
    own = cut(both_ways(ties).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")), "groups")
    total = own.agg(F.sum("k")).first()[0] or 1.0
    labels = cut(own.select("id", F.col("id").alias("label")), "labels")
    mass = lambda end: own.select(F.col("id").alias(end), F.col("k").alias(f"k{end}"))  # noqa: B023, E731
    left = cut(ties.where("a != b").select("a", "b", "w").join(mass("a"), "a").join(mass("b"), "b").select("a", "b", "ka", "kb", "w"), "left")
    while True:
        known = left.withColumn("gain", F.round(F.col("w") - resolution * F.col("ka") * F.col("kb") / total, 9)).where("gain > 0")
        known = known.withColumn("turn", F.xxhash64("a", "b"))
        side = lambda u, v: F.struct(F.col(u).alias("id"), F.col(f"k{u}").alias("k"), F.struct("gain", "turn", F.col(v).alias("to"), F.col(f"k{v}").alias("k")).alias("wish"))
        wishes = known.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).groupBy(F.col("e.id").alias("id"), F.col("e.k").alias("k")).agg(F.max("e.wish").alias("wish"))
        ranked = lambda k, id_: F.struct(F.col(k).alias("k"), F.xxhash64(id_).alias("turn"), F.col(id_).alias("id"))
        willing = cut(wishes.select("id", "k", F.col("wish.to").alias("to"), F.col("wish.k").alias("kt")).where(ranked("k", "id") < ranked("kt", "to")).select("id", "to"), "gains")
        moves = cut(willing.join(willing.select(F.col("id").alias("to")), "to", "left_anti").select("id", F.col("to").alias("label")), "moves")
        drop(willing)
        if moves.isEmpty():
            drop(moves)
            drop(own)
            return labels, left
        named = own.join(moves, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "k")
        bigger = named.groupBy(F.col("label").alias("whole")).agg(F.sum("k").alias("mass"))
        map_ = cut(named.join(bigger, dealt("label") == dealt("whole")).select("id", "label", "mass"), "map")
        parts = [left, own, labels, moves]
        to = lambda end: map_.select(F.col("id").alias(end), F.col("label").alias(f"{end}_to"), F.col("mass").alias(f"{end}_k"))  # noqa: B023, E731
        renamed = left.join(to("a"), "a").join(to("b"), "b").where("a_to != b_to")
        first = F.col("a_to") < F.col("b_to")
        renamed = renamed.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"), F.when(first, F.col("a_k")).otherwise(F.col("b_k")).alias("ka"), F.when(first, F.col("b_k")).otherwise(F.col("a_k")).alias("kb"), "w")
        left = cut(renamed.groupBy("a", "b").agg(F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.sum("w").alias("w")), "left")
        own = cut(map_.select(F.col("label").alias("id"), F.col("mass").alias("k")).distinct(), "groups")
        labels = cut(labels.join(map_.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")), "labels")
        for used in (*parts, map_):
            drop(used)


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 0.8, least: int = 5) -> DataFrame:
    """id and community of every symbol that has a tie: groups joined while that raises the modularity, then moves of single symbols, then groups joined again; small ones merged, and numbered by size.

    A group grows along ties, so it is connected; where symbols left one, it is cut into its parts.
    """
    numbers, ties = numbered_subgraph(nodes, edges)
    return named_communities(communities_of(ties, resolution, least), numbers)


def named_communities(labels: DataFrame, numbers: DataFrame) -> DataFrame:
    """Communities of numbered symbols (id, label), as id and community of the symbols themselves."""
    return number_communities(labels.join(numbers.withColumnRenamed("id", "name"), F.col("id") == F.col("n")).select(F.col("name").alias("id"), "label"))


def communities_of(ties: DataFrame, resolution: float = 0.8, least: int = 5) -> DataFrame:
    """id and label: the communities of numbered symbols by their ties."""
    start, between = grown(ties, resolution)
    # What is between groups is known; what is inside one is what its members have beside.
    loops = start.join(both_ways(ties).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")), "id").groupBy("label").agg(F.sum("k").alias("k"))
    out = both_ways(between).groupBy(F.col("u").alias("label")).agg(F.sum("w").alias("out"))
    loops = loops.join(out, "label", "left").select(F.col("label").alias("a"), F.col("label").alias("b"), ((F.col("k") - F.coalesce("out", F.lit(0.0))) / 2).alias("w"))
    labels = local_moves(ties, resolution, start=start, above=between.select("a", "b", "w").unionByName(loops))
    drop(between)
    # Groups that a symbol left may have lost their middle, and labels of groups that stand are no one's but theirs.
    left = cut(start.join(labels, ["id", "label"], "left_anti").select("label").distinct(), "left")
    if not left.isEmpty():
        torn = cut(labels.join(left, "label", "left_semi").select("id", "label"), "torn")
        parts = connected_parts(torn, ties)
        labels = cut(labels.join(left, "label", "left_anti").select("id", F.struct(F.lit(0).alias("cut"), "label").alias("label")).unionByName(parts.select("id", F.struct(F.lit(1).alias("cut"), "label").alias("label"))), "labels")
        heads = labels.groupBy("label").agg(F.min("id").alias("head"))
        labels = cut(labels.join(heads, "label").select("id", F.col("head").alias("label")), "labels")
    above = cut(contracted(ties, labels), "above")
    higher = agglomerated(above, resolution)
    labels = cut(labels.join(higher.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")), "labels")
    labels = merge_small(labels, ties, least)
    drop(above)
    return labels


def connected_parts(labels: DataFrame, ties: DataFrame) -> DataFrame:
    """Every community cut into its connected parts (by ties inside it), each labelled by its smallest member.

    A move takes a node away that may have held its old community together; the parts are what the next level moves, so
    no community ever joins what no tie joins. Labels spread from neighbour to neighbour, and jump to the label of
    their label, so rounds grow with the logarithm of a part's width.
    """
    named = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    inside = ties.select("a", "b").where("a != b").join(named("a"), "a").join(named("b"), "b").where("a_label = b_label")
    links = cut(inside.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(inside.select(F.col("b").alias("u"), F.col("a").alias("v"))), "inside")
    part = cut(labels.select("id", F.col("id").alias("label")), "parts")
    while True:
        offered = links.join(part.select(F.col("id").alias("u"), "label"), "u").groupBy(F.col("v").alias("id")).agg(F.min("label").alias("offer"))
        near = part.join(offered, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        jump = part.select(F.col("id").alias("over"), F.col("label").alias("far"))
        new = cut(near.join(jump, dealt("label") == dealt("over"), "left").select("id", F.least("label", "far").alias("label"), "was"), "parts")
        same = new.where("label != was").isEmpty()
        drop(part)
        part = new.select("id", "label")
        part._graphloom_path = new._graphloom_path
        if same:
            drop(links)
            return part


def merge_small(labels: DataFrame, ties: DataFrame, least: int = 5) -> DataFrame:
    """Communities of fewer than `least` go to the neighbour that they have most ties with, until none has a neighbour.

    One that would go to a smaller label, or to one that stays anyhow, is willing; the willing go whose choice is not
    willing itself. So each round ends at least one community, in a ring of them not all change places, and what is
    tied stays tied.
    """
    labels = cut(labels.select("id", "label"), "labels")
    sizes = cut(labels.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    if sizes.where(F.col("n") < least).isEmpty():
        return labels
    # Only communities meet from here on: how many ties each two of them have, and where each went.
    pairs = cut(both_ways(contracted(ties.where("a != b").select("a", "b", F.lit(1).alias("w")), labels).where("a != b")), "pairs")
    gone = cut(sizes.select("label", F.col("label").alias("to")), "gone")
    while True:
        low = sizes.where(F.col("n") < least).select(F.col("label").alias("u"))
        wishes = pairs.join(low, "u", "left_semi").groupBy(F.col("u").alias("label")).agg(F.max_by("v", F.struct("w", "v")).alias("to"))
        going = wishes.select(F.col("label").alias("to"), F.lit(True).alias("going"))
        willing = cut(wishes.join(going, "to", "left").where("going is null or label > to").select("label", "to"), "willing")
        moves = cut(willing.join(willing.select(F.col("label").alias("to")), "to", "left_anti").select("label", "to"), "moves")
        if moves.isEmpty():
            return cut(labels.join(gone, "label").select("id", F.col("to").alias("label")), "labels")
        new = sizes.join(moves, "label", "left").select("label", F.coalesce("to", "label").alias("to"), "n")
        map_ = cut(new, "map")
        pairs = cut(pairs.join(map_.select(F.col("label").alias("u"), F.col("to").alias("nu")), "u").join(map_.select(F.col("label").alias("v"), F.col("to").alias("nv")), "v").where("nu != nv").groupBy(F.col("nu").alias("u"), F.col("nv").alias("v")).agg(F.sum("w").alias("w")), "pairs")
        gone = cut(gone.join(map_.select(F.col("label").alias("to"), F.col("to").alias("up")), "to").select("label", F.col("up").alias("to")), "gone")
        sizes = cut(map_.groupBy(F.col("to").alias("label")).agg(F.sum("n").alias("n")), "sizes")


def number_communities(labels: DataFrame) -> DataFrame:
    """Communities numbered from 0 by size, largest first, ties by smallest member."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return labels.join(numbered(sizes, [F.desc("size"), "first"], "community").select("label", "community"), "label").select("id", "community")


def cohesion(members: DataFrame, ties: DataFrame) -> DataFrame:
    """community, size and cohesion (ties inside over possible ones)."""
    one = members.select(F.col("id").alias("a"), F.col("community").alias("ca")), members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = ties.join(one[0], "a").join(one[1], "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("ties"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).join(inside, "community", "left")
    possible = F.col("size") * (F.col("size") - 1) / 2
    return sizes.select("community", "size", F.when(F.col("size") < 2, 0.0).otherwise(F.round(F.coalesce("ties", F.lit(0)) / possible, 4)).alias("cohesion"))


def top_symbols(members: DataFrame, degree: DataFrame, k: int = 5) -> DataFrame:
    """community, place (from 1) and id of each community's `k` symbols of highest degree."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    return members.join(degree.select("id", "degree"), "id").withColumn("place", place).where(F.col("place") <= k).select("community", "place", "id", "degree")


def content_hash(members: DataFrame) -> DataFrame:
    """community and a hash of its members; the members' ids are joined in one string, as the hash is defined on it."""
    return members.groupBy("community").agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list("id")), "|")), 1, 16).alias("content_hash"))


def heuristic_names(members: DataFrame, nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """community and name: its commonest top directory and its symbol of highest degree."""
    own = members.join(nodes.select("id", "name", "file"), "id").withColumn("top", F.when(F.col("file").isNull(), "(external)").when(F.col("file").contains("/"), F.substring_index("file", "/", 1)).otherwise("(root)"))
    tops = own.groupBy("community", "top").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("top", F.struct(-F.col("n"), F.col("top"))).alias("top"))
    lead = own.join(degree.select("id", "degree"), "id").groupBy("community").agg(F.min_by("name", F.struct(-F.col("degree"), F.col("id"))).alias("lead"))
    return tops.join(lead, "community").select("community", F.concat("top", F.lit(" · "), "lead").alias("name"))


def community_files(members: DataFrame, nodes: DataFrame) -> DataFrame:
    return members.join(nodes.where("file is not null").select("id", "file"), "id").groupBy("community", "file").agg(F.count("*").alias("n"))


def god_nodes(nodes: DataFrame, degree: DataFrame, k: int = 20) -> DataFrame:
    """The symbols of highest degree."""
    own = nodes.where(~structural(F.col("kind"))).select("id", "kind", "name", "file").join(degree, "id").where("degree > 0")
    return own.orderBy(F.desc("degree"), "id").limit(k)


def import_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct file pairs (src, dst) with an import between them."""
    files = nodes.select("id", F.coalesce("file", "qualified").alias("path"))
    own = edges.where("relation = 'imports'").select(F.col("src").alias("s"), F.col("dst").alias("d"))
    pairs = own.join(files.select(F.col("id").alias("s"), F.col("path").alias("src")), "s").join(files.select(F.col("id").alias("d"), F.col("path").alias("dst")), "d")
    return pairs.select("src", "dst").where("src != dst").distinct()


def strongly_connected(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and component of every strongly connected component of two or more nodes; component is its smallest node.

    Nodes without a way in or out are trimmed. Then the smallest label that reaches each node spreads forward to a
    fixpoint; from each label's own node, the nodes of that label that reach it are its component. What is
    settled leaves, with the ties between labels, and the rest goes on until nothing is left. Labels are in the order
    of a hash, so that a chain of components falls apart into short pieces. `most_rounds` bounds only the trimming
    before each spread, which saves work and settles nothing by itself.
    """
    left, settled = cut(pairs.select("src", "dst").where("src != dst").distinct(), "scc"), None
    while True:
        for _ in range(most_rounds):  # trim
            ends = left.select("src").distinct().join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            inner = cut(left.join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "scc")
            done = inner.count() == left.count()
            drop(left)
            left = inner
            if done:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        color = cut(nodes.withColumn("color", F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("own"))), "color")
        while True:
            offered = left.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("color").alias("offer"))
            new = cut(color.join(offered, F.col("node") == F.col("to"), "left").select("node", F.least("color", "offer").alias("color"), (F.coalesce("offer", "color") < F.col("color")).alias("changed")), "color")
            over = new.where("changed").isEmpty()
            drop(color)
            color = new.select("node", "color")
            color._graphloom_path = new._graphloom_path
            if over:
                break
        # Backward from each color's own node, within the color.
        same = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color"))
        same = cut(same, "same")
        reach = cut(color.where("node = color.own"), "reach")
        frontier = reach
        while True:
            back = same.join(frontier.select(F.col("node").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            new = cut(back.join(reach, ["node", "color"], "left_anti"), "reach")
            if new.isEmpty():
                break
            reach, frontier = cut(reach.unionByName(new), "reach"), new
        found = reach.select("node", F.col("color").alias("component"))
        settled = found if settled is None else settled.unionByName(found)
        gone = reach.select("node")
        left = cut(same.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    if settled is None:
        return pairs.sparkSession.createDataFrame([], "node string, component string")
    big = settled.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("component", "least")
    return settled.join(big, "component").select("node", F.col("least").alias("component"))


def layers(pairs: DataFrame) -> DataFrame:
    """node, component and layer: how many ties the longest way from anything without a way in has, each strongly connected component being one.

    Rounds as many as there are layers; each takes the components whose ways in are all done.
    """
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    own = cut(ends.join(strongly_connected(pairs), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    named = lambda end: own.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    left = cut(pairs.join(named("src"), "src").join(named("dst"), "dst").where("src_c != dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct(), "condensed")
    open_, layer, done = own.select("component").distinct(), 0, None
    while True:
        held = left.select(F.col("dst").alias("component")).distinct()
        free = cut(open_.join(held, "component", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        done = free if done is None else done.unionByName(free)
        if left.isEmpty():
            return own.join(done, "component").select("node", "component", "layer")
        open_ = cut(held, "open")
        rest = cut(left.join(free.select(F.col("component").alias("src")), "src", "left_anti").select("src", "dst"), "condensed")
        drop(left)
        left, layer = rest, layer + 1


def import_cycles(nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    """size and files of the `k` largest import cycles."""
    found = strongly_connected(import_graph(nodes, edges))
    return found.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("files")).orderBy(F.desc("size"), "component").limit(k).select("size", "files")


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that neither import nor are imported."""
    pairs = import_graph(nodes, edges)
    tied = pairs.select(F.col("src").alias("path")).unionByName(pairs.select(F.col("dst").alias("path"))).distinct()
    return nodes.where("kind = 'file'").select(F.coalesce("file", "qualified").alias("path")).join(tied, "path", "left_anti")


def cross_community(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are in different communities."""
    own = edges.where(~F.col("relation").isin("contains", "defines"))
    own = own.join(members.select(F.col("id").alias("src"), F.col("community").alias("src_community")), "src").join(members.select(F.col("id").alias("dst"), F.col("community").alias("dst_community")), "dst")
    return own.where("src_community != dst_community")


def analysis_stats(nodes: DataFrame, edges: DataFrame, members: DataFrame, degree: DataFrame) -> DataFrame:
    """One row: communities, largest, nodes, orphans, cross-community edges and god nodes."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    one = sizes.agg(F.count("*").alias("communities"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    for name, df in (("nodes", nodes), ("orphans", orphan_files(nodes, edges)), ("cross", cross_community(edges, members)), ("gods", god_nodes(nodes, degree))):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return one
