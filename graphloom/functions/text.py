"""Text functions as Column expressions: slugs, redaction, labels, paths, ids, line counts, snippets, markers."""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F

# What counts as a secret, in the order of application.
URL_CREDENTIALS = r"(?i)(\b[a-z][a-z0-9+.-]*://[^/\s:@]+:)([^@\s/]+)(@)"
KEY_SECRET = r"(?i)((?:api[_-]?key|apikey|secret|token|password|passwd|access[_-]?key|private[_-]?key|client[_-]?secret)\s*[:=]\s*)(['\"]?)([^\s'\"]{6,})\2"
BEARER = r"(?i)\b(bearer\s+)([A-Za-z0-9._\-+/=]{8,})"
# Parts of a path that mark a test.
TEST_MARKERS = ("/tests/", "/test/", "/__tests__/", "/spec/", "test_", "_test.", ".test.", ".spec.")
# Targets that may be cloned.
SCHEME = r"^(?:https?|git|ssh)://"
SCP_LIKE = r"^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+:[^\s]+$"


def slug(text: Column, limit: int = 80) -> Column:
    """A file-name-safe lower-case form; `unnamed` where nothing is left."""
    safe = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "-")
    safe = F.lower(F.regexp_replace(safe, r"^-+|-+$", ""))
    return F.substring(F.when(safe == "", "unnamed").otherwise(safe), 1, limit)


def redact_url(text: Column) -> Column:
    """Without passwords in URLs."""
    return F.regexp_replace(text, URL_CREDENTIALS, "$1***$3")


def redact_secrets(text: Column) -> Column:
    """Without passwords in URLs, values of secret-like keys, and bearer tokens."""
    return F.regexp_replace(F.regexp_replace(redact_url(text), KEY_SECRET, "$1$2***$2"), BEARER, "$1***")


def sanitize_label(text: Column, limit: int = 256) -> Column:
    """One line without control characters or repeated white space."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", " ")
    return F.substring(F.regexp_replace(F.regexp_replace(clean, r"(?U)\s+", " "), "^ | $", ""), 1, limit)


def clean_doc(text: Column, limit: int = 400) -> Column:
    """A docstring without its quotes, on one line."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1$", "$2")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, limit)


def safe_text(text: Column) -> Column:
    """Whether a target is not empty, has no control character or white space, and does not start with - or ~."""
    clean = F.trim(text)
    return F.coalesce((clean != "") & ~clean.rlike(r"[\x00-\x1f\x7f]") & ~clean.rlike(r"(?U)\s") & ~clean.rlike("^[-~]"), F.lit(False))


def git_url(text: Column) -> Column:
    """Whether a target may be cloned: a known scheme with host and path, or user@host:path."""
    clean = F.trim(text)
    return safe_text(text) & ~clean.contains("::") & (clean.rlike("(?i)" + SCHEME + r"[^/]+/.+") | (clean.rlike(SCP_LIKE) & ~clean.contains("://")))


def repo_relative(path: Column) -> Column:
    """The path with / between its parts and without `.`; null where it is absolute or climbs out."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | slashed.rlike(r"[\x00-\x1f\x7f]")
    return F.when(~bad, F.array_join(parts, "/"))


def within(base: str, path: str) -> bool:
    """Whether a local path, links resolved, lies in `base`."""
    root, own = os.path.realpath(base), os.path.realpath(path)
    return own == root or own.startswith(root.rstrip(os.sep) + os.sep)


def is_test_path(path: Column) -> Column:
    own = F.concat(F.lit("/"), F.lower(path))
    hit = F.lit(False)
    for marker in TEST_MARKERS:
        hit = hit | own.contains(marker)
    return hit


def line_count(text: Column) -> Column:
    """Newlines, and one more where the last line has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1))


def as_latin(content: Column) -> Column:
    """Bytes as text of one letter each."""
    return F.decode(content, "ISO-8859-1")


def lines_of(text: Column, start: Column | int, stop: Column | int) -> Column:
    """Lines start to stop, from 1; at most 201."""
    first = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    last = F.least(F.lit(stop) if isinstance(stop, int) else stop, first + 200)
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def snippet(text: Column, row: Column, radius: int = 1, limit: int = 240) -> Column:
    """The lines around a row (from 0), stripped."""
    first = F.greatest(row - radius, F.lit(0))
    window = F.slice(F.split(text, "\n"), first + 1, row + radius - first + 1)
    return F.substring(F.trim(F.regexp_replace(F.array_join(window, "\n"), r"^\s+|\s+$", "")), 1, limit)


def markers(text: Column, words: tuple[str, ...] = ("TODO", "FIXME", "XXX", "HACK", "NOTE")) -> Column:
    """Every marker with up to 80 letters of what follows."""
    return F.regexp_extract_all(text, F.lit(r"\b((?:" + "|".join(words) + r")\b[:\s]?.{0,80})"), 1)


def split_list(text: Column) -> Column:
    """A comma-separated list, trimmed and without empties; null if nothing is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def progress(state: Column, current: Column, total: Column) -> Column:
    """Share of the work done."""
    return F.when(state == "done", 1.0).when(total > 0, F.least(F.lit(1.0), current / total)).otherwise(0.0)


def first_json_object(text: Column) -> Column:
    """The JSON object in a model's answer (fences and talk around it dropped), as text; {} if there is none."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner), F.lit("{}"))


def symbol_id(language: Column, path: Column, qualified: Column, kind: Column, ordinal: Column) -> Column:
    """<language>:<path>#<qualified>.<kind>, with #<n> from the second of a name on."""
    return F.concat(language, F.lit(":"), path, F.lit("#"), qualified, F.lit("."), kind, F.when(ordinal > 0, F.concat(F.lit("#"), ordinal.cast("string"))).otherwise(""))


def node_id(prefix: str, value: Column) -> Column:
    """repo:, dir:, file: and ext: ids."""
    return F.concat(F.lit(prefix + ":"), value)


def file_of_node(node: Column) -> Column:
    """The path in a symbol's id."""
    return F.regexp_extract(F.substring_index(node, "#", 1), r"^[^:]*:(.*)$", 1)


def last_segment(text: Column) -> Column:
    """The last part of a dotted name without leading * or []."""
    return F.element_at(F.split(F.regexp_replace(text, r"^[*\[\]]+", ""), r"\."), -1)


def looks_like_type(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Za-z0-9_]*$")


def valid_repo_id(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9._@-]{1,200}$")


def valid_job_id(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9-]{4,64}$")


def repo_id_local(path: Column) -> Column:
    return F.concat(F.lit("local-"), slug(F.element_at(F.split(path, "/"), -1)), F.lit("-"), F.substring(F.sha1(path), 1, 6))


def repo_id_git(host: Column, owner: Column, name: Column, ref: Column, url: Column) -> Column:
    return F.concat(slug(host), F.lit("__"), slug(owner), F.lit("__"), slug(name), F.lit("@"), slug(F.coalesce(ref, F.lit("head"))), F.lit("-"), F.substring(F.sha1(F.concat(url, F.lit("@"), F.coalesce(ref, F.lit("")))), 1, 6))


def scrub_environment(env: dict[str, str]) -> dict[str, str]:
    """Variables whose names do not look like secrets."""
    words = ("key", "token", "secret", "password", "passwd", "credential")
    return {k: v for k, v in env.items() if not any(w in k.lower() for w in words)}
