"""What a working copy says of its commit: HEAD, branches, packed references and worktrees, read without a git program."""

from __future__ import annotations

import os
import re

COMMIT = re.compile(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")
MAX_BYTES = 4 << 20


def _read(path: str) -> str | None:
    try:
        handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(handle, "rb") as file:
            data = file.read(MAX_BYTES + 1)
    except OSError:
        return None
    return data.decode("utf-8", "replace").strip() if len(data) <= MAX_BYTES else None


def head(root: str) -> dict[str, str | None]:
    """commit and branch of a working copy; both null where there is none, or where what is there makes no sense."""
    nothing: dict[str, str | None] = {"commit": None, "branch": None}
    folder = os.path.join(root, ".git")
    if os.path.isfile(folder):  # a worktree or submodule names its folder
        named = re.match(r"^gitdir: (.+)$", _read(folder) or "")
        if not named:
            return nothing
        folder = os.path.normpath(os.path.join(root, named[1]))
    first = _read(os.path.join(folder, "HEAD"))
    if first is None:
        return nothing
    if COMMIT.match(first):
        return {"commit": first, "branch": None}
    named = re.match(r"^ref: (refs/[^\s]+)$", first)
    if not named or ".." in named[1].split("/"):
        return nothing
    reference = named[1]
    common = _read(os.path.join(folder, "commondir"))
    places = [folder, *([os.path.normpath(os.path.join(folder, common))] if common else [])]
    commit = next((x for p in places if (x := _read(os.path.join(p, *reference.split("/")))) and COMMIT.match(x)), None)
    if commit is None:
        for line in (x for p in places for x in (_read(os.path.join(p, "packed-refs")) or "").splitlines()):
            parts = line.split(" ")
            if len(parts) == 2 and parts[1] == reference and COMMIT.match(parts[0]):
                commit = parts[0]
    return {"commit": commit, "branch": reference.removeprefix("refs/heads/") if reference.startswith("refs/heads/") else None}
