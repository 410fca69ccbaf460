"""Language detection by file name, extension and first line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File names, extensions and interpreter names, in the order in which they are tried.
BY_NAME = {"rakefile": "ruby", "gemfile": "ruby", "vagrantfile": "ruby", "podfile": "ruby", ".bashrc": "bash", ".bash_profile": "bash", ".profile": "bash", ".zshrc": "bash", "dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make"}
EXTENSIONS = {
    "python": "py pyi pyw", "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "rust": "rs", "c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "c_sharp": "cs", "ruby": "rb rake gemspec", "php": "php phtml", "kotlin": "kt kts", "swift": "swift", "bash": "sh bash",
    "json": "json", "yaml": "yaml yml", "html": "html htm", "css": "css", "markdown": "md markdown", "toml": "toml", "ini": "ini cfg conf", "text": "txt", "rst": "rst", "sql": "sql", "xml": "xml", "protobuf": "proto", "graphql": "graphql gql",
}
BY_INTERPRETER = (("python", "python"), ("node", "javascript"), ("deno", "typescript"), ("bash", "bash"), ("/sh", "bash"), ("zsh", "bash"), ("ruby", "ruby"), ("php", "php"), ("swift", "swift"))
DISPLAY_ONLY = ("markdown", "toml", "ini", "text", "rst", "sql", "xml", "protobuf", "graphql", "dockerfile", "make")
BY_EXTENSION = {x: language for language, names in EXTENSIONS.items() for x in names.split()}
PARSABLE = tuple(language for language in EXTENSIONS if language not in DISPLAY_ONLY)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def detect(path: Column, first_line: Column | None = None) -> Column:
    """The language of a file; `unknown` where nothing tells."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    found = [_lookup(BY_NAME, F.lower(name)), _lookup(BY_EXTENSION, extension)]
    if first_line is not None:
        line = F.lower(first_line)
        by = F.lit(None).cast("string")
        for needle, language in reversed(BY_INTERPRETER):
            by = F.when(line.contains(needle), language).otherwise(by)
        found.append(F.when(first_line.startswith("#!"), by))
    return F.coalesce(*found, F.lit("unknown"))


def is_parsable(language: Column) -> Column:
    return language.isin(*PARSABLE)


def is_display_only(language: Column) -> Column:
    return language.isin(*DISPLAY_ONLY)


def grammar_table(spark):
    """language, parsable and display_only of every known language."""
    return spark.createDataFrame([(x, x in PARSABLE, x in DISPLAY_ONLY) for x in sorted({*PARSABLE, *DISPLAY_ONLY})], "language string, parsable boolean, display_only boolean")
