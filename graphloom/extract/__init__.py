"""Extraction of symbols, references and imports from source files: one extractor a language, run by `mapInPandas`.

`register` adds an extractor; languages without one of their own go to the generic one.
"""

from __future__ import annotations

import contextlib
import json
import signal
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.language import PARSABLE
from ..schema import EXTRACTION, IMPORT, REFERENCE, SYMBOL
from .base import Extraction
from .generic import extract_generic
from .go import extract_go
from .java import extract_java
from .python import extract_python
from .typescript import extract_typescript

EXTRACTORS = {"python": extract_python, "typescript": extract_typescript, "tsx": extract_typescript, "javascript": extract_typescript, "go": extract_go, "java": extract_java}


def register(language: str, extractor) -> None:
    """`extractor(path, source) -> Extraction` for a language; on a cluster, register before the session's workers start."""
    EXTRACTORS[language] = extractor


#: Seconds that one file may take, and bytes that it may have.
MOST_SECONDS, MOST_BYTES = 10.0, 1 << 20
#: Files whose extractions a worker holds before it hands them on.
FILES_AT_ONCE = 64


@contextlib.contextmanager
def time_limit(seconds: float):
    """Raises TimeoutError in the body after so many seconds; only where signals reach, in a process's main thread."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract_source(path: str, language: str, source: bytes, seconds: float = MOST_SECONDS) -> Extraction:
    """Never raises: what an extractor throws is kept among the errors, and a file that is too large or takes too long has not parsed."""
    out = Extraction(path, language if language in EXTRACTORS else "generic")
    if language not in PARSABLE and language not in EXTRACTORS:
        out.parse_ok, out.error = False, "no_grammar"
        return out
    if len(source) > MOST_BYTES:
        out.parse_ok, out.error = False, "too_large"
        return out
    try:
        with time_limit(seconds):
            return EXTRACTORS.get(language, extract_generic)(path, source, language)
    except TimeoutError:
        out.parse_ok, out.error = False, "parse_timeout"
        return out
    except Exception as e:
        out.errors.append(f"{type(e).__name__}: {e}")
        return out


def extract_files(files: DataFrame) -> DataFrame:
    """One row (EXTRACTION) for each parsable file of a scan (path, language, content, and repo if there are several)."""
    files = files if "repo" in files.columns else files.withColumn("repo", F.lit("repo"))
    flat = "repo string, path string, language string, symbols string, references string, imports string, errors array<string>, parse_ok boolean, error string, node_count bigint, error_count bigint, missing_count bigint"

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + FILES_AT_ONCE] for whole in batches for i in range(0, len(whole), FILES_AT_ONCE)):
            rows = [extract_source(p, x, bytes(c or b"")) for p, x, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True)]
            yield pd.DataFrame([(repo, r.path, r.language, json.dumps(r.symbols), json.dumps(r.references), json.dumps(r.imports), r.errors, r.parse_ok, r.error, r.node_count, r.error_count, r.missing_count) for repo, r in zip(pdf["repo"], rows, strict=True)], columns=[c.split()[0] for c in flat.split(", ")])

    own = files.where(F.col("language").isin(*{*PARSABLE, *EXTRACTORS})).select("repo", "path", "language", "content").mapInPandas(extracted, flat)
    typed = own.withColumns({c: F.from_json(c, f"array<{t}>") for c, t in (("symbols", SYMBOL), ("references", REFERENCE), ("imports", IMPORT))})
    return typed.select(*[c.split()[0] for c in EXTRACTION.split(", ") if c[0].islower() and c.split()[0] in typed.columns])
