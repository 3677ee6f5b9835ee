"""Configuration, scopes and working copies; all on the driver, nothing here grows with the data."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from skein.functions.text import UNITS

#: Default budgets (requests, repositories, lexical, dense, warm readers) and overlay caps.
BUDGETS = {"max_concurrent_requests": 2, "max_concurrent_repo_searches": 4, "max_concurrent_lexical": 2, "max_concurrent_dense": 2, "max_warm_repos": 4}
OVERLAY_FILES, OVERLAY_BYTES = 500, 25 * 1024**2
#: Dimensions of known embedding models.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768}


@dataclass
class Config:
    groups: dict[str, list[str]] = field(default_factory=dict)
    default_group: str | None = None
    search: dict[str, int] = field(default_factory=lambda: dict(BUDGETS))
    overlay_files: int = OVERLAY_FILES
    overlay_bytes: int = OVERLAY_BYTES
    profiles: dict[str, dict] = field(default_factory=dict)

    def scope(self, name: str | None = None) -> list[str]:
        """Repositories of a group, or of one absolute path; of the default group without a name."""
        if name is None:
            name = self.default_group or next(iter(self.groups), None)
        if name in self.groups:
            return self.groups[name]
        if name and os.path.isabs(name):
            return [clean_path(name)]
        raise ValueError(f"no such scope: {name}")

    def repos(self) -> list[str]:
        return sorted({r for g in self.groups.values() for r in g})


def byte_size(text: str | int) -> int:
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) * UNITS[m[2].lower()]


def clean_path(path: str, base: str | None = None) -> str:
    """Absolute, with ``~``, ``.`` and ``..`` resolved by name."""
    p = os.path.expanduser(path)
    return os.path.normpath(p if os.path.isabs(p) else os.path.join(base or os.getcwd(), p))


def load(path: str) -> Config:
    """Read and check a TOML file; relative paths are relative to it."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    base = str(Path(path).resolve().parent)
    out = Config(default_group=raw.get("default_group"), profiles=raw.get("profiles", {}))
    for g in raw.get("groups", []):
        name = g.get("id", "").strip()
        if not name or name in out.groups:
            raise ValueError(f"groups need unique names: {name!r}")
        out.groups[name] = list(dict.fromkeys(clean_path(r, base) for r in g.get("repos", [])))
        if not out.groups[name]:
            raise ValueError(f"group {name} is empty")
    for k, v in raw.get("search", {}).items():
        if k in BUDGETS and int(v) <= 0:
            raise ValueError(f"{k} must be positive")
        out.search[k] = int(v)
    overlay = raw.get("overlay", {})
    out.overlay_files = int(overlay.get("max_files", OVERLAY_FILES))
    out.overlay_bytes = byte_size(overlay.get("max_bytes", OVERLAY_BYTES))
    return out


def overlay_id(common_dir: str, root: str) -> str:
    return hashlib.md5(f"{common_dir}:{root}".encode()).hexdigest()[:16]


def inside(root: str, path: str) -> bool:
    """Does the path, links resolved, lie below the root?"""
    real = os.path.realpath(os.path.join(root, path))
    return real == os.path.realpath(root) or real.startswith(os.path.realpath(root) + os.sep)


def fingerprint(root: str) -> dict[str, str | int | None]:
    """Head and times of a working copy, of the first version control that answers; else of the root alone."""

    def said(*command: str) -> str | None:
        try:
            p = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=10, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return p.stdout.strip() or None if p.returncode == 0 else None

    head = said("git", "rev-parse", "HEAD") or said("jj", "log", "-r", "@", "--no-graph", "-T", "commit_id") or said("hg", "id", "-i") or said("svn", "info", "--show-item", "revision")
    index = Path(root, ".git", "index")
    return {"last_head": head, "last_index_mtime": _millis(index), "last_root_mtime": _millis(Path(root))}


def _millis(path: Path) -> int | None:
    try:
        return path.stat().st_mtime_ns // 1_000_000
    except OSError:
        return None
