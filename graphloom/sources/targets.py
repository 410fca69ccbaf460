"""What to index: a folder, or the address of a repository; and a shallow copy of the latter."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from ..functions.text import scrub_environment

#: Schemes that may be fetched, and the host of addresses that name none.
SCHEMES = ("http", "https", "git", "ssh")
DEFAULT_HOST = "github.com"


@dataclass(frozen=True)
class Place:
    """A `folder` that is there, or an `address` whose `names` are the parts of its path, the repository last."""

    folder: str | None = None
    address: str | None = None
    host: str | None = None
    names: tuple[str, ...] = ()
    ref: str | None = None
    subdir: str | None = None

    @property
    def name(self) -> str:
        return self.names[-1] if self.names else "repo"

    @property
    def owner(self) -> str:
        return "/".join(self.names[:-1])


def slug(text: str, limit: int = 80) -> str:
    """Small letters, digits and ._- only; `unnamed` if nothing is left."""
    runs = re.findall(r"[a-z0-9._]+", text.lower().replace("-", " "))
    return "-".join(runs)[:limit] or "unnamed"


def plain(text: str, what: str) -> str:
    """The text itself if a command line can take it as one word: not empty, no blanks or control characters, no - or ~ in front."""
    if not text or text[0] in "-~" or any(c.isspace() or not c.isprintable() for c in text):
        raise ValueError(f"unsafe {what}: {text!r}")
    return text


def below(subdir: str) -> str:
    """A path inside the repository, with / between its parts; ValueError where it is absolute or climbs."""
    parts = subdir.replace("\\", "/").split("/")
    if parts[0] == "" or re.fullmatch(r"[A-Za-z]:", parts[0][:2]) or ".." in parts or not subdir.isprintable():
        raise ValueError(f"not a path inside the repository: {subdir!r}")
    return "/".join(p for p in parts if p not in ("", "."))


def split_address(text: str) -> tuple[str, str, str]:
    """Address, host and path of `scheme://host/path`, `user@host:path` or `owner/name`."""
    if "://" in text:
        parsed = urlsplit(text)
        if parsed.scheme.lower() not in SCHEMES:
            raise ValueError(f"unknown scheme: {parsed.scheme}")
        return text, parsed.hostname or "", parsed.path
    login, colon, path = text.partition(":")
    if colon:
        user, _, host = login.partition("@")
        return text, host if user else "", path
    if text.count("/") == 1 and all(re.fullmatch(r"[A-Za-z0-9][\w.-]*", x, re.ASCII) for x in text.split("/")):
        return f"https://{DEFAULT_HOST}/{text.removesuffix('.git')}.git", DEFAULT_HOST, text
    raise ValueError(f"neither a folder nor an address: {text}")


def locate(text: str, ref: str | None = None, subdir: str | None = None) -> Place:
    """Reads a target; ValueError where it is neither a folder that is there nor an address that may be fetched."""
    extra = {"ref": plain(ref, "ref") if ref else None, "subdir": below(subdir) if subdir else None}
    text = text.strip()
    if not text or "::" in text:
        raise ValueError("an empty or unsafe target")
    folder = os.path.realpath(os.path.expanduser(text))
    if os.path.isdir(folder):
        return Place(folder=folder, names=(os.path.basename(folder),), **extra)
    if text[0] in "/~" or text.split("/")[0] in (".", ".."):
        raise ValueError(f"no such folder: {text}")
    address, host, path = split_address(plain(text, "target"))
    names = tuple(p for p in path.removesuffix("/").removesuffix(".git").split("/") if p)
    if not host or not names:
        raise ValueError(f"an address without host or path: {text}")
    return Place(address=address, host=host, names=names, **extra)


def repo_id(place: Place) -> str:
    """One id for the same folder, or for the same address and ref."""
    if place.folder:
        return f"local-{slug(place.name)}-{hashlib.sha1(place.folder.encode()).hexdigest()[:6]}"
    mark = hashlib.sha1(f"{place.address}@{place.ref or ''}".encode()).hexdigest()[:6]
    return "__".join((slug(place.host), slug(place.owner or "none"), slug(place.name))) + f"@{slug(place.ref or 'head')}-{mark}"


def checkout(place: Place, clones: str) -> str:
    """The folder itself, or where a copy of the address stands or would stand."""
    return place.folder or os.path.join(clones, *map(slug, (place.host, place.owner or "none", place.name, place.ref or "head")))


def index_root(place: Place, clones: str) -> str:
    """The folder to scan; links that lead out of the checkout are refused."""
    base = os.path.realpath(checkout(place, clones))
    inner = os.path.realpath(os.path.join(base, place.subdir or ""))
    if os.path.commonpath((base, inner)) != base:
        raise ValueError("the subdirectory is outside the checkout")
    return inner


def fetch(place: Place, clones: str, run: Callable = subprocess.run, seconds: float = 600) -> str:
    """A shallow copy of an address, made anew unless it is there; its folder. Nothing of the repository is executed."""
    at = checkout(place, clones)
    if place.folder or os.path.isdir(os.path.join(at, ".git")):
        return at
    os.makedirs(os.path.dirname(at), exist_ok=True)
    command = ["git", "-c", "core.hooksPath=/dev/null", "clone", "--depth", "1", "--single-branch", "--no-tags"]
    command += ["--branch", place.ref] if place.ref else []
    environment = scrub_environment(dict(os.environ)) | {"GIT_TERMINAL_PROMPT": "0", "GIT_LFS_SKIP_SMUDGE": "1"}
    run([*command, "--", place.address, at], check=True, env=environment, timeout=seconds, capture_output=True)
    return at
