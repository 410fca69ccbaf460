"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`. Sources in code point order (null last) weigh 5, 2, 1
and so on, and share `share` times all sizes; a target stops at `most` times its source's size, and the excess goes
to the others by weight (water filling: one level, under which each source's target is weight times level or its
stop).

The words of a source, documents shuffled by a hash, are one stream that repeats; it is cut into blocks of
BLOCK_WORDS words. A schedule hands out slots: golden-ratio points run through the cumulated weights, the point of a
slot names its source, and slots are ranked within their source. The slot of rank k reads block k. Points come
within a few slots of each source's due; slots beyond it are dropped, and missing ones are added at the end.
Running sums and ranks are taken in two levels (within buckets of documents or runs of slots, then over those), so
that no source needs one task.

Nulls: a text is empty, a source is a source of its own, a doc_id is a value like any other. Documents of size 0 take
nothing. Repeated rows are documents of their own, ordered by doc_id and size. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BLOCK_WORDS = 256
SHARE, MOST = 1.5, 2
WEIGHTS = (5, 2, 1)
#: Cells of the unit interval by which slots meet their source.
CELLS = 4096
#: Slots ranked together.
RUN = 1 << 16
#: The golden ratio's fraction as a 32-bit integer: points are exact multiples of it.
GOLDEN = 2654435769
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, sid (its number in code point order), source_size, target and words (the whole words due) of each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    filled = Window.orderBy("ratio", "sid")
    before, rest, all_ = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_) * SHARE - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))) / F.sum("weight").over(rest)
    filled_up = numbered.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * MOST / F.col("weight")).withColumn("level", level)
    one = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(all_)["level"]
    target = F.least(F.col("weight") * one, (F.col("source_size") * MOST).cast("double"))
    return filled_up.select("source", "sid", "source_size", target.alias("target")).withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * MOST).cast("bigint"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid and k: in slot order, the source to read next and the number of its block. `sources` is what `targets` gives."""
    due = sources.select("sid", F.ceil(F.col("words") / block).cast("bigint").alias("due")).where("due > 0")
    total = due.agg(F.coalesce(F.sum("due"), F.lit(0))).first()[0]
    upto = F.sum("due").over(Window.orderBy("sid"))
    shares = due.select("sid", "due", ((upto - F.col("due")) / total).alias("low"), (upto / total).alias("high"))
    cells = shares.select("sid", "due", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = ((F.col("id") % (1 << 31)) * GOLDEN) % (1 << 32) / F.lit(float(1 << 32))
    slots = sources.sparkSession.range(total).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    placed = slots.join(cells, "cell").where("point >= low and point < high").select("slot", "sid", "due", F.floor(F.col("slot") / RUN).alias("run"))
    runs = placed.groupBy("sid", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("first", F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n"))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(runs.select("sid", "run", "first"), ["sid", "run"])
    given = ranked.select("slot", "sid", (F.col("first") + F.col("r")).alias("k"), "due").where("k < due").drop("due")
    got = runs.groupBy("sid").agg(F.sum("n").alias("got"))
    added = due.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < due")
    added = added.select("sid", F.explode(F.sequence("got", F.col("due") - 1)).alias("k")).withColumn("slot", total + F.row_number().over(Window.orderBy("k", "sid")) - 1)
    return given.unionByName(added)


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its source's numbers and the place of its first word in the source's shuffled stream; (sid, bucket, place) is its key."""
    mixed = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("mixed", mixed).withColumn("bucket", F.substring("mixed", 1, 3))
    own = Window.partitionBy("sid", "bucket").orderBy("mixed", "doc_id", "size")
    rows = rows.withColumn("place", F.row_number().over(own)).withColumn("within", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    buckets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    return rows.join(buckets, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "mixed")


def segments(rows: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The parts of each row that lie in one block, for each time the stream is read; rows of which nothing is read have one with k null."""
    begin = F.col("start") + F.col("time") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.col("words"))
    timed = rows.withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("begin", begin).withColumn("end", end)
    at: Column = F.when(F.col("begin") < F.col("end"), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    cutup = timed.withColumn("k", F.explode_outer(at))
    return cutup.withColumn("low", F.greatest("begin", F.col("k") * block)).withColumn("high", F.least("end", (F.col("k") + 1) * block))


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (the first of the schedule that reads the row, null if none does) and slots (how many do) of every row of `docs` (doc_id, text, source)."""
    sized = cut(sizes(docs), "sizes")
    sources = cut(targets(sized), "targets")
    parts = segments(streams(sized, sources), block).join(schedule(sources, block), ["sid", "k"], "left")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("high") - F.col("low")).otherwise(0))
    out = parts.groupBy("sid", "bucket", "place", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("slots"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


def mixed(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, in slot order: slot, source, k (the block of its stream), doc_id, and the words first to before `stop` of that document."""
    sized = cut(sizes(docs), "sizes")
    sources = cut(targets(sized), "targets")
    parts = segments(streams(sized, sources), block).join(schedule(sources, block), ["sid", "k"])
    words = parts.select("slot", "source", "k", "doc_id", (F.col("low") - F.col("begin")).alias("first"), (F.col("high") - F.col("begin")).alias("stop"), "low")
    return words.orderBy("slot", "low").drop("low")


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, source_size * 2 / [5, 2, 1][sid % 3 + 1] AS ratio FROM per),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
target AS (SELECT source, source_size, least(weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, sid LIMIT 1), (source_size * 2)::DOUBLE) AS target FROM levels),
due AS (SELECT *, least(floor(target + 0.5), source_size * 2)::BIGINT AS words FROM target),
placed AS (SELECT row_number() OVER () AS row, doc_id, size, source_size, target, words, due.source,
  (sum(size) OVER (PARTITION BY due.source ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized JOIN due ON sized.source IS NOT DISTINCT FROM due.source),
blocks AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS sid, ceil(words / 256)::BIGINT AS due FROM due),
shares AS (SELECT *, (sum(due) OVER (ORDER BY sid) - due)::BIGINT / (SELECT sum(due)::BIGINT FROM blocks) AS low, (sum(due) OVER (ORDER BY sid))::BIGINT / (SELECT sum(due)::BIGINT FROM blocks) AS high FROM blocks WHERE due > 0),
points AS (SELECT slot, ((slot % 2147483648) * 2654435769) % 4294967296 / 4294967296::DOUBLE AS point FROM (SELECT unnest(range((SELECT coalesce(sum(due), 0)::BIGINT FROM blocks))) AS slot)),
ranked AS (SELECT slot, source, sid, due, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM points JOIN shares ON point >= low AND point < high),
missing AS (SELECT source, sid, unnest(range(got, due)) AS k FROM (SELECT s.source, s.sid, s.due, count(r.slot) AS got FROM shares s LEFT JOIN ranked r ON r.sid = s.sid GROUP BY ALL)),
schedule AS (SELECT slot, source, k FROM ranked WHERE k < due UNION ALL SELECT (SELECT sum(due)::BIGINT FROM blocks) + row_number() OVER (ORDER BY k, sid) - 1, source, k FROM missing),
times AS (SELECT row, source, start + t * source_size AS begin, least(start + t * source_size + size, words) AS stop FROM placed, (VALUES (0), (1)) v(t)),
reads AS (SELECT row, min(slot) AS first_slot, count(*) AS slots FROM times JOIN schedule s ON times.source IS NOT DISTINCT FROM s.source AND k BETWEEN begin // 256 AND (stop - 1) // 256 WHERE begin < stop GROUP BY row)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, words) - start) + greatest(0, least(start + size + source_size, words) - start - source_size))::BIGINT AS taken,
  first_slot::BIGINT AS first_slot, coalesce(slots, 0)::BIGINT AS slots FROM placed LEFT JOIN reads USING (row)
"""
