"""Per-path options: inherited configuration, scopes and output keys. Plain Python, no Spark.

Options are nested dictionaries that follow the record's keys; the last key names the
option. Entries of None are as if absent. List positions have no keys: options for a list hold for
all its elements.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from typing import Any

Path = tuple[str, ...]
Entries = list[tuple[Path, Any]]


def flatten(options: Mapping | None, at: Path = ()) -> Entries:
    """(path, value) of every entry that isn't None."""
    found: Entries = []
    for key, value in (options or {}).items():
        if isinstance(value, Mapping):
            found += flatten(value, (*at, key))
        elif isinstance(value, list):
            raise TypeError(f"options can't hold a list (at {'/'.join((*at, key))})")
        elif value is not None:
            found.append(((*at, key), value))
    return found


def above(entry: Path, path: Path) -> bool:
    """Whether an entry lies on the way to a leaf, so that it holds there."""
    return path[: len(entry) - 1] == entry[:-1]


def resolve(entries: Entries, path: Path, defaults: Mapping[str, Any]) -> dict[str, Any]:
    """The options that hold at a leaf: of the entries on its way the deepest, else the default."""
    out = dict(defaults)
    for name in defaults:
        near = [(len(p), v) for p, v in entries if p[-1] == name and above(p, path)]
        if near:
            out[name] = max(near, key=lambda x: x[0])[1]
    return out


def in_scope(entries: Entries, path: Path) -> bool:
    """An empty scope admits all. Else one denial on the way denies, whatever its depth; without an entry a leaf is out."""
    if not entries:
        return True
    on_way = [bool(v) for p, v in entries if above(p, path)]
    return bool(on_way) and all(on_way)


def output_names(paths: Sequence[Path], existing: Mapping[Path, Sequence[str]], output_key: str | Callable[[list[str]], str]) -> dict[Path, str | None]:
    """The sibling's name for each leaf path; None where a key of that name exists, for the old value stays.

    Two leaves that would write one new key are an error.
    """
    name_of = output_key if callable(output_key) else (lambda path: output_key)
    out: dict[Path, str | None] = {}
    taken: dict[tuple[Path, str], Path] = {}
    for path in paths:
        name = name_of(list(path))
        if any(name.lower() == x.lower() for x in existing.get(path[:-1], ())):
            warnings.warn(f"output key {name!r} exists beside {'/'.join(path)}; the old value stays", stacklevel=2)
            out[path] = None
            continue
        other = taken.setdefault((path[:-1], name.lower()), path)
        if other != path:
            raise ValueError(f"{'/'.join(other)} and {'/'.join(path)} would both write {name!r}")
        out[path] = name
    return out
