"""Git working copies: which checkout of a repository is indexed, and which are overlays of it."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path

from skein.sources.config import clean_path, overlay_id


@dataclass(frozen=True)
class Identity:
    """The top of a checkout, the git folder that all checkouts of a repository share, and whether it is the main one."""

    root: str
    shared: str
    main: bool


@dataclass(frozen=True)
class Context:
    """What a requested path is searched as: an indexed repository, and the overlay of its working copy if it is one."""

    repo: str
    copy: str | None = None
    overlay: str | None = None


def identity(path: str) -> Identity | None:
    """None if there is no such folder, no git, or no checkout."""

    def git(*args: str) -> str:
        try:
            done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return ""
        return done.stdout.strip() if done.returncode == 0 else ""

    if not Path(path).exists():
        return None
    top, shared = git("rev-parse", "--show-toplevel"), git("rev-parse", "--path-format=absolute", "--git-common-dir")
    if not top or not shared:
        return None
    return Identity(clean_path(top), clean_path(shared), Path(top, ".git").is_dir())


def main_checkouts(repos: list[str]) -> dict[str, str]:
    """Shared git folder to the one main checkout among the configured ``repos``; none or several are an error."""
    by_shared: dict[str, dict[str, bool]] = {}
    for one in filter(None, map(identity, repos)):
        by_shared.setdefault(one.shared, {})[one.root] = one.main
    out = {}
    for shared, roots in by_shared.items():
        mains = [r for r, main in roots.items() if main]
        if len(mains) != 1:
            raise ValueError(f"{shared} needs exactly one main checkout among {sorted(roots)}")
        out[shared] = mains[0]
    return out


def context(path: str, repos: list[str], overlays: bool = True) -> Context:
    """A configured repository is itself; another checkout of one is its overlay; anything else is a repository of its own."""
    path = clean_path(path)
    known = {clean_path(r) for r in repos}
    if not overlays or path in known and (identity(path) is None or identity(path).main):
        return Context(path)
    me = identity(path)
    main = main_checkouts(repos).get(me.shared) if me else None
    if main is None or main == me.root:
        return Context(path)
    return Context(main, me.root, overlay_id(me.shared, me.root))


def pick(repos: list[str], hint: str | None, one: bool = False) -> str | None:
    """The repository that a hint names by its whole path or its last part; without a hint the only one, if ``one`` is asked for."""
    if hint is None:
        if one and len(repos) != 1:
            raise ValueError("name a repository: the scope has several")
        return repos[0] if one else None
    hint = hint.strip()
    found = [r for r in repos if hint in (r, Path(r).name)]
    if len(found) != 1:
        raise ValueError(f"{hint!r} is {'ambiguous' if found else 'not'} in the scope")
    return found[0]
