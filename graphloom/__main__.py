"""python -m graphloom index TARGET [--ref REF] [--subdir DIR] [--repo ID] [--catalog DIR] | status | search TEXT | export FILE.(json|md|html)"""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    parser.add_argument("command", choices=("index", "status", "search", "export"))
    parser.add_argument("what", nargs="?", default="")
    parser.add_argument("--repo")
    parser.add_argument("--ref")
    parser.add_argument("--subdir")
    parser.add_argument("--catalog", default=os.path.abspath(".graphloom"))
    own = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from .operators import build, query
    from .plans import export
    from .plans.catalog import TABLES, Catalog
    from .plans.engine import Engine, Index
    from .sources.targets import fetch, index_root, locate, repo_id

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    catalog = Catalog(spark, own.catalog)
    if own.command == "index":
        place, clones = locate(own.what, own.ref, own.subdir), f"{own.catalog}/clones"
        fetch(place, clones)
        index = Engine(spark).index(index_root(place, clones), place.name)
        catalog.save(index, own.repo or repo_id(place))
        print(json.dumps(catalog.info(own.repo or repo_id(place)), indent=1))
    elif own.command == "status":
        for row in catalog.repositories().collect():
            print(row["repo_id"], row["indexed_at"], row["files"], row["nodes"], row["edges"])
    else:
        repo = catalog.default(own.repo)
        tables = {t: catalog.table(repo, t) for t in TABLES}
        if own.command == "search":
            for row in query.search(tables["nodes"], build.degrees(tables["nodes"], tables["edges"]), own.what).collect():
                print(row["kind"], row["id"])
        else:
            index = Index(repo=repo, parsed=0, **tables)
            kind = own.what.rpartition(".")[2]
            text = {"json": lambda: json.dumps(export.graph_json(index)), "md": lambda: export.report(index), "html": lambda: export.graph_html(index)}[kind]()
            with open(own.what, "w", encoding="utf-8") as f:
                f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
