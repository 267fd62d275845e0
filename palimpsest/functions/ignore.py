"""Ignore files: which paths the rules of the nearest ignore file above them, and of those above it, leave out."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: str) -> list[str]:
    return [p for p in path.split("/") if p]


def parents(folders: list[str]) -> tuple[list[str], list[int | None]]:
    """The folders in the order of their parts, and for each the number of the nearest folder above it."""
    order = sorted(folders, key=_parts)
    at = {tuple(_parts(f)): k for k, f in enumerate(order)}
    out: list[int | None] = []
    for f in order:
        parts = _parts(f)
        out.append(next((at[tuple(parts[:n])] for n in range(len(parts) - 1, -1, -1) if tuple(parts[:n]) in at), None))
    return order, out


def _pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            out, i = out + re.escape(glob[i]), i + 1
    return out


def rules(text: str, folder: str = "") -> list[tuple[bool, bool, re.Pattern]]:
    """(leaves out, only folders, pattern of a path) for each line of an ignore file in ``folder``."""
    base = "".join(re.escape(p) + "/" for p in _parts(folder))
    out = []
    for line in text.splitlines():
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line.startswith("#"):
            continue
        kept, line = line.startswith("!"), line.removeprefix("!")
        only, line = line.endswith("/"), line.rstrip("/")
        inner = "" if "/" in line else "(?:.*/)?"
        out.append((not kept, only, re.compile(base + inner + _pattern(line.lstrip("/")) + r"\Z")))
    return out


class Ignored:
    """Ignore files by folder, in the paths of one collection."""

    def __init__(self, files: dict[str, str]):
        self.order, up = parents(list(files))
        self.keys = [_parts(f) for f in self.order]
        self.chains: list[list] = []
        for k, f in enumerate(self.order):
            above = self.chains[up[k]] if up[k] is not None else []
            self.chains.append([*above, *rules(files[f], f)])

    def __call__(self, path: str) -> bool:
        """Whether a path, or a folder above it, is left out by the last rule that speaks of it."""
        parts = _parts(path)
        k = bisect_right(self.keys, parts) - 1
        while k >= 0 and parts[: len(self.keys[k])] != self.keys[k]:
            k -= 1
        if k < 0:
            return False
        for n in range(1, len(parts) + 1):
            name, state = "/".join(parts[:n]), None
            for out, only, pattern in self.chains[k]:
                if (n < len(parts) or not only) and pattern.match(name):
                    state = out
            if state:
                return True
        return False


def is_ignored(path: Column, files: dict[str, str]) -> Column:
    """Whether each path is left out; a null path is not. The rules go to the workers with the code."""
    test = Ignored(files)

    @F.pandas_udf("boolean")
    def ask(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p is not None and p == p and test(p)).astype(bool)

    return ask(path)
