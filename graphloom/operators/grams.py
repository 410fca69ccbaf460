"""Search in names by an index of grams: posting lists in folders by gram, intersected, and what is left verified.

The grams of a text are its pieces of 1, 2 and 3 characters, in lower case. A node has those of its name, qualified
name and file; nodes that share all three are listed once, under the smallest id among them. A needle is cut at its wildcards (% and _); each run of three or more characters asks for its grams of
three, a shorter one for itself. Of these the RAREST few are read, by the counts that are kept beside the lists; the
ids on all of them lead to the folders of the nodes, which are held against the pattern. No name is scanned but where the
needle has nothing besides wildcards, which every node matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..storage import Buckets, cut, dealt, drop
from .query import like_pattern, search_hit

SIZES = (1, 2, 3)
#: Posting lists that a search reads.
RAREST = 4
TEXTS = ("name", "qualified", "file")
#: Kinds that no search finds.
HIDDEN = ("repo", "dir", "community")


def grams(text):
    """The distinct grams of a text in lower case."""
    low = F.lower(text)

    def pieces(size: int):
        at = F.sequence(F.lit(1), F.char_length(low) - (size - 1))
        return F.when(F.char_length(low) >= size, F.transform(at, lambda i: F.substring(low, i, size)))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(pieces, SIZES)))))


def asked(needle: str) -> list[str]:
    """The grams that any text with the needle in it has."""
    out: set[str] = set()
    for run in re.split(r"[%_]+", needle.lower()):
        if run:
            out |= {run[i : i + 3] for i in range(len(run) - 2)} or {run}
    return sorted(out)


@dataclass(frozen=True)
class Grams:
    """Posting lists (gram, text, held: nodes of these texts), nodes a gram (gram, n), and the nodes with their degree by text."""

    postings: Buckets
    counts: Buckets
    nodes: Buckets

    @classmethod
    def write(cls, nodes: DataFrame, degree: DataFrame, n: int = 32) -> Grams:
        shown = nodes.where(~F.col("kind").isin(*HIDDEN))
        texts = cut(shown.groupBy(*TEXTS).agg(F.min("id").alias("text"), F.count("*").alias("held")), "texts")
        given = F.filter(F.array(*TEXTS), lambda t: t.isNotNull())
        lists = texts.select(F.explode(F.array_distinct(F.flatten(F.transform(given, grams)))).alias("gram"), "text", "held")
        postings = Buckets.write(lists, "gram", "postings", n)
        counts = Buckets.write(postings.rows.groupBy("gram").agg(F.sum("held").alias("n")), "gram", "gram-counts", n)
        # As structs, null texts are equal to each other.
        own = texts.select(dealt(*TEXTS).alias("texts"), "text")
        listed = shown.join(own, dealt(*TEXTS) == F.col("texts")).drop("texts").join(degree.select("id", "degree"), "id")
        searched = Buckets.write(listed, "text", "searched", n)
        drop(texts)
        return cls(postings, counts, searched)

    @property
    def parts(self) -> list[Buckets]:
        return [self.postings, self.counts, self.nodes]

    def candidates(self, needle: str) -> DataFrame | None:
        """Texts on the shortest posting lists of the needle's grams; None where it has none."""
        own = asked(needle)
        if not own:
            return None
        known = {r["gram"]: r["n"] for r in self.counts.of(own).collect()}
        rarest = sorted(own, key=lambda g: (known.get(g, 0), g))[:RAREST]
        hit = self.postings.of(rarest).groupBy("text").agg(F.count("*").alias("n"))
        return hit.where(F.col("n") == len(rarest)).select("text")

    def search(self, needle: str, kinds=None, limit: int = 50) -> DataFrame:
        """The nodes, with degree, that `query.search` finds."""
        found = self.candidates(needle.strip())
        own = (self.nodes.rows if found is None else self.nodes.matching(found)).where(search_hit(like_pattern(needle.strip())) & F.lit(bool(needle.strip())))
        if kinds:
            own = own.where(F.col("kind").isin(*kinds))
        return own.drop("text").orderBy(F.desc("degree"), "qualified", "id").limit(limit)
