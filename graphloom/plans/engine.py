"""The whole run over a source tree: scan, extract, resolve, build, analyze; and the update of an earlier run."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..extract import extract_files
from ..operators import analyze, build, imports, resolve
from ..operators.traverse import Stored
from ..sources.tree import TABLE, Limits, Scan, scan_table, scan_tree
from ..storage import Buckets, Layer, cut, drop, replaced
from . import incremental

#: What a file's parse says beside its symbols.
PARSED = ("parse_ok", "error", "node_count", "error_count", "missing_count")
#: An update of more files than these leaves no layer: its tables are written anew when they are asked for.
MOST_TOUCHED = 5_000
#: Updates that stand on one another before tables are written anew.
MOST_LAYERS = 8
MOST_EXTERNAL = 400
TABLES = ("files", "references", "nodes", "plain", "inside")


class Parts:
    """Attributes that are given as values, or as functions that make them when they are first asked for."""

    def __init__(self, **given):
        self._given = given

    def __getattr__(self, name: str):
        given = vars(self).get("_given", {})
        if name not in given:
            raise AttributeError(name)
        found = given[name]() if callable(given[name]) else given[name]
        setattr(self, name, found)
        return found


class Kept(Parts):
    """What an update asks of an earlier run, beside its results.

    `targets` are the resolved imports, whose packages are listed when they are read. `symbols` and `referring` (resolved references) lie in folders by name, where an
    update finds whom a changed name reaches. `outside` are the edges of all imports that name no file, `top` the names
    (repo, dst) of those that show. No edge has a larger `seq` than `last`.
    """


class Index(Parts):
    """Everything that a run makes, as tables, each made when it is first asked for, as communities, walks and call statistics are.

    `edges` are `plain` and `inside`, the imports of files by files, which are listed when they are read, unless they are given whole.
    """

    def __init__(self, repo: str, skipped: DataFrame, extractions: DataFrame, parsed: int = 0, touched: int = 0, kept: Kept | None = None, layers: int = 0, members: DataFrame | None = None, **tables):
        """`tables` are files, references, nodes, plain and inside; others may be given that would else be made of these."""
        super().__init__(**tables)
        vars(self).update({name: tables[name] for name in ("edges", "stats") if name in tables})
        self.repo, self.skipped, self.extractions = repo, skipped, extractions
        self.parsed, self.touched, self.kept, self.layers, self._members = parsed, touched, kept, layers, members

    @cached_property
    def edges(self) -> DataFrame:
        return self.plain.unionByName(self.inside)

    @property
    def import_counts(self) -> DataFrame:
        """repo, src, dst and n: the edges of imports between each two ends."""
        if "counts" in self._given:
            return self.counts
        return self.edges.where("relation = 'imports'").groupBy("repo", "src", "dst").agg(F.count("*").alias("n"))

    def of(self, repo: str) -> Index:
        """The part of one repository, where a table held several; a community never spans two. It can be read, not updated."""
        own = lambda df: df.where(F.col("repo") == repo) if "repo" in df.columns else df
        return Index(repo, own(self.skipped), own(self.extractions), self.parsed, self.touched, **{name: lambda name=name: own(getattr(self, name)) for name in TABLES})

    @cached_property
    def stats(self) -> DataFrame:
        return resolve.call_stats(self.references)

    @property
    def members(self) -> DataFrame:
        if self._members is None:
            self._members = cut(analyze.communities(self.nodes, self.edges), "members")
        return self._members

    @property
    def degrees(self) -> DataFrame:
        return build.degrees(self.nodes, self.edges)

    @cached_property
    def walks(self) -> Stored:
        """The edges stored for traversals."""
        return Stored.write(self.edges)

    def compact(self) -> Index:
        """The same tables without layers; imports of files are a row a package again."""
        old = self.kept
        symbols, referring = cache(lambda: Buckets.write(old.symbols.rows, "name", "symbols")), cache(lambda: Buckets.write(old.referring.rows, "name", "references"))
        found = cut(self.extractions, "extractions")
        targets = cache(lambda: imports.resolved_imports(found).cut())
        kept = Kept(targets=lambda: targets().rows, symbols=symbols, referring=referring, outside=lambda: cut(old.outside, "outside"), top=lambda: cut(old.top, "top"), last=lambda: old.last)
        return Index(
            self.repo, self.skipped, found, self.parsed, self.touched, kept, files=lambda: cut(self.files, "files"), references=lambda: referring().rows, nodes=lambda: cut(self.nodes, "nodes"),
            plain=lambda: cut(self.plain, "edges"), inside=lambda: build.in_stage(imports.ordered_inside_edges(imports.import_rows(found), targets()), 1),
        )


class Engine:
    """`Engine(spark).index(path)` for a tree, `.index_table(df)` for a table of files; `.update(index, path)` and `.update_table` for an index that is to follow them.

    Where no limits are given, a tree has those of `Limits`, and a table is read whole.
    """

    def __init__(self, spark: SparkSession, limits: Limits | None = None):
        self.spark, self.limits, self.table_limits = spark, limits or Limits(), limits or TABLE

    def index(self, root: str, repo: str = "repo", cached: DataFrame | None = None) -> Index:
        return self.build(scan_tree(self.spark, root, self.limits), repo, cached)

    def index_table(self, contents: DataFrame, repo: str = "repo", cached: DataFrame | None = None) -> Index:
        return self.build(scan_table(contents, self.table_limits), repo, cached)

    def update(self, index: Index, root: str) -> Index:
        return self.follow(index, scan_tree(self.spark, root, self.limits))

    def update_table(self, index: Index, contents: DataFrame) -> Index:
        return self.follow(index, scan_table(contents, self.table_limits))

    def build(self, scan: Scan, repo: str, cached: DataFrame | None = None) -> Index:
        """Files with a column `repo` are of so many repositories, which are indexed together and never mixed; ids are unique in each. `cached` is the `extractions` of an earlier run: files of the same content are not parsed again."""
        scanned = cut(_with_repo(scan.files, repo), "scan")
        fresh = incremental.changed(scanned, cached) if cached is not None else scanned
        extracted = cut(_extracted(fresh), "extracted")
        parsed = extracted.count()
        found = cut(incremental.refreshed(scanned, cached, extracted), "extractions") if cached is not None else extracted
        return self._resolved(repo, scanned, scan.skipped, found, parsed)

    def _resolved(self, repo: str, scanned: DataFrame, skipped: DataFrame, found: DataFrame, parsed: int) -> Index:
        rows = imports.import_rows(found)
        files = cache(lambda: cut(_files(scanned, found), "files"))
        targets = cache(lambda: imports.resolved_imports(found).cut())
        symbols = cache(lambda: Buckets.write(build.symbols(found), "name", "symbols"))
        referring = cache(lambda: Buckets.write(resolve.resolve_references(found, targets(), symbols().rows), "name", "references"))
        outside = cache(lambda: cut(imports.outside_edges(rows, targets()), "outside"))
        top = cache(lambda: cut(imports.top_externals(outside(), MOST_EXTERNAL), "top"))
        shown = lambda: outside().join(top(), ["repo", "dst"], "left_semi").select(*outside().columns)
        written = lambda *stages: cut(build.dedup_edges(build.sequenced(build.staged(*stages)), "seq"), "edges")
        # Imports of whole packages are as many edges as pairs of files; they are listed when edges of imports are read, and stand between the others.
        before = cache(lambda: written(build.structure(files())[1], build.symbol_graph(symbols().rows)[1]))

        @cache
        def after() -> DataFrame:
            referred = resolve.reference_edges(referring().rows, found, symbols().rows)
            return written(shown(), referred, build.test_edges(referred, files()))

        def nodes() -> DataFrame:
            own = build.structure(files())[0].unionByName(build.symbol_graph(symbols().rows)[0])
            return cut(own.unionByName(build.external_nodes(after().select("repo", F.col("dst").alias("id")))), "nodes")

        def counts() -> DataFrame:
            inside = imports.inside_counts(rows, targets())
            inside = inside.select("repo", F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("file:"), "target").alias("dst"), "n")
            return inside.unionByName(shown().select("repo", "src", "dst", "sl", "sc").distinct().groupBy("repo", "src", "dst").agg(F.count("*").alias("n")))

        kept = Kept(targets=lambda: targets().rows, symbols=symbols, referring=referring, outside=outside, top=top, last=(3 << build.STAGE_BITS) - 1)
        return Index(
            repo, skipped, found, parsed, parsed, kept, files=files, references=lambda: referring().rows, nodes=nodes, counts=counts,
            plain=lambda: build.in_stage(before(), 0).unionByName(build.in_stage(after(), 2)), inside=lambda: build.in_stage(imports.ordered_inside_edges(rows, targets()), 1),
        )

    def follow(self, index: Index, scan: Scan) -> Index:
        """The index of what was scanned now, made of an earlier one: the same tables as a whole run gives, but for `seq`, which goes on behind the edges that stand.

        Only files of other content are parsed, and only files that a change reaches are resolved (`incremental`), however many
        they are. What they had is replaced by layers, and all else stands as it is.
        """
        if index.kept is None:
            raise ValueError("only what a run of this engine gave can be updated, whole")
        key = ["repo", "path"]
        scanned = cut(_with_repo(scan.files, index.repo), "scan")
        changed = scanned.join(index.files.select(*key, "sha256"), [*key, "sha256"], "left_anti")
        gone = index.files.join(scanned.select(*key), key, "left_anti").select(*key, F.lit(True).alias("moves"))
        known = changed.join(index.files.select(*key, F.lit(True).alias("known")), key, "left")
        dirty = cut(known.select(*key, F.col("known").isNull().alias("moves")).unionByName(gone), "dirty")
        if dirty.isEmpty():
            drop(scanned)
            drop(dirty)
            return index
        own, moves = dirty.select(*key), not dirty.where("moves").isEmpty()
        changed = cut(scanned.join(own, key, "left_semi"), "changed")
        drop(scanned)
        before, after = cut(index.extractions.join(own, key, "left_semi"), "before"), cut(_extracted(changed), "after")
        names = cut(incremental.changed_names(before, after), "names")
        paths = incremental.moved(before, after)
        reached = incremental.reached(names, index.kept.referring, paths, imports.import_rows(index.extractions) if not paths.isEmpty() else None)
        touched = cut(own.unionByName(reached.select(*key)).distinct(), "places")
        return self._patched(index, scan.skipped, changed, own, moves, touched, after)

    def _patched(self, index: Index, skipped: DataFrame, changed: DataFrame, dirty: DataFrame, moves: bool, touched: DataFrame, after: DataFrame) -> Index:
        """`dirty` files are read anew, `touched` resolved anew; `moves` says whether files came or went, so that the tree is built anew."""
        key, kept = ["repo", "path"], index.kept
        found = replaced(index.extractions, dirty, after)
        part = cut(found.join(touched, key, "left_semi"), "touched")
        rows, at = imports.import_rows(part), touched.select("repo", F.col("path").alias("file"))
        own = cache(lambda: cut(build.symbols(part), "symbols"))
        symbols = cache(lambda: Layer(kept.symbols, dirty, own().join(dirty, key, "left_semi")))
        targets = cache(lambda: imports.resolved_imports(part, paths=found.select(*key)).cut())

        @cache
        def references() -> DataFrame:
            known = symbols().matching(resolve.reference_rows(part).select("name"))
            return cut(resolve.resolve_references(part, targets(), cut(known, "known")), "references")

        fresh_outside = cache(lambda: cut(imports.outside_edges(rows, targets()), "outside"))
        outside = cache(lambda: replaced(kept.outside, touched, fresh_outside(), "file"))
        top = cache(lambda: cut(imports.top_externals(outside(), MOST_EXTERNAL), "top"))
        files = cache(lambda: replaced(index.files, dirty, _files(changed, after)))

        @cache
        def tree() -> tuple[DataFrame, DataFrame]:
            nodes, edges = build.structure(files() if moves else files().join(touched, key, "left_semi"))
            return (nodes, edges) if moves else (nodes.where("kind = 'file'"), edges.limit(0))

        @cache
        def fresh() -> DataFrame:
            # Of modules outside, some may show now that did not.
            risen = top().join(kept.top, ["repo", "dst"], "left_anti").select("repo", "dst")
            others = outside().join(at, ["repo", "file"], "left_anti").join(risen, ["repo", "dst"], "left_semi")
            shown = fresh_outside().join(top(), ["repo", "dst"], "left_semi").select(*fresh_outside().columns).unionByName(others.select(*fresh_outside().columns))
            referred = resolve.reference_edges(references(), part, own())
            made = build.staged(tree()[1], build.symbol_graph(own())[1], imports.inside_edges(rows, targets()).unionByName(shown), referred, build.test_edges(referred, files()))
            return cut(build.dedup_edges(build.sequenced(made), "seq").withColumn("seq", F.col("seq") + F.lit(kept.last + 1)), "edges")

        between = (F.col("relation") == "imports") & F.col("dst").startswith("file:")

        def plain() -> DataFrame:
            # And others, the other way round.
            sunk = kept.top.join(top(), ["repo", "dst"], "left_anti").select("repo", "dst")
            stand = index.plain.where(F.col("file").isNotNull()) if moves else index.plain
            import_edges = stand.where("relation = 'imports'").join(sunk, ["repo", "dst"], "left_anti").select(*stand.columns)
            return replaced(stand.where("relation != 'imports'").unionByName(import_edges), touched, fresh().where(~between), "file")

        def nodes() -> DataFrame:
            gone = ("external", "repo", "dir", "file") if moves else ("external",)
            made = replaced(index.nodes.where(~F.col("kind").isin(*gone)), touched, tree()[0].unionByName(build.symbol_graph(own())[0]), "file")
            told = out.plain.where("relation != 'imports'").select("repo", "dst").unionByName(outside().join(top(), ["repo", "dst"], "left_semi").select("repo", "dst"))
            return made.unionByName(build.external_nodes(told.withColumnRenamed("dst", "id")))

        referring = cache(lambda: Layer(kept.referring, touched, references()))
        last = lambda: fresh().agg(F.coalesce(F.max("seq"), F.lit(kept.last))).first()[0]
        now = Kept(targets=lambda: replaced(kept.targets, touched, targets().rows), symbols=symbols, referring=referring, outside=outside, top=top, last=last)
        out = Index(
            index.repo, skipped, found, after.count(), touched.count(), now, index.layers + 1, files=files, references=lambda: referring().rows, nodes=nodes,
            plain=plain, inside=lambda: replaced(index.inside, touched, fresh().where(between), "file"),
        )
        return out.compact() if out.layers > MOST_LAYERS or out.touched > MOST_TOUCHED else out


def _with_repo(files: DataFrame, repo: str) -> DataFrame:
    return files if "repo" in files.columns else files.withColumn("repo", F.lit(repo))


def _extracted(files: DataFrame) -> DataFrame:
    return extract_files(files).join(files.select("repo", "path", "sha256"), ["repo", "path"])


def _files(scanned: DataFrame, found: DataFrame) -> DataFrame:
    return scanned.drop("content").join(found.select("repo", "path", *PARSED), ["repo", "path"], "left")
