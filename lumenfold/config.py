"""Settings from a TOML file, checked as a whole before anything runs."""

from __future__ import annotations

import string
import tomllib
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

from lumenfold.operators.dedup import PREFERENCES

#: The fields a destination template may name.
TEMPLATE_FIELDS = ("year", "month", "day", "hour", "minute", "second", "timestamp", "source", "original_name", "stem", "extension", "asset_id")


class ConfigError(ValueError):
    """What is wrong with the settings, all of it."""


@dataclass(frozen=True)
class Source:
    name: str
    root: str
    priority: int = 0


@dataclass(frozen=True)
class Scan:
    directories: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".heic", ".png", ".dng", ".mov", ".mp4")


@dataclass(frozen=True)
class Dates:
    least_year: int = 1970
    most_year: int = 2100
    sequence_gap: int = 5
    time_gap_hours: int = 24


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    library: str
    scan: Scan = field(default_factory=Scan)
    dates: Dates = field(default_factory=Dates)
    prefer: tuple[str, ...] = PREFERENCES
    overrides: dict[str, int] = field(default_factory=dict)
    default_directory: str = "Imported"
    directories: dict[str, str] = field(default_factory=dict)
    template: str = "{year}/{original_name}"


def overlap(a: str, b: str) -> bool:
    """One folder is the other, or lies inside it."""
    x, y = PurePosixPath(a), PurePosixPath(b)
    return x == y or x in y.parents or y in x.parents


def _section(kind: type, data: dict[str, Any], name: str, wrong: list[str]) -> Any:
    known = kind.__dataclass_fields__
    wrong += [f"{name}: unknown setting {k}" for k in data if k not in known]
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known}
    default = kind()
    for k, v in list(values.items()):
        if type(v) is not type(getattr(default, k)):
            wrong.append(f"{name}.{k}: {type(getattr(default, k)).__name__} expected")
            del values[k]
    return kind(**values)


def parse(text: str) -> Config:
    """The settings of a TOML text; ``ConfigError`` lists everything that is wrong."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"no TOML: {error}") from error
    wrong: list[str] = []
    allowed = {"library", "sources", "scan", "dates", "keeper", "imports"}
    wrong += [f"unknown section {k}" for k in data if k not in allowed]
    sources = []
    for i, s in enumerate(data.get("sources", [])):
        name, root, priority = s.get("name"), s.get("root"), s.get("priority", 0)
        if not isinstance(name, str) or not name.strip() or not isinstance(root, str) or not root.startswith("/"):
            wrong.append(f"sources[{i}]: a name and an absolute root are needed")
        elif not isinstance(priority, int) or isinstance(priority, bool) or priority < 0:
            wrong.append(f"sources[{i}]: the priority is a number from 0")
        else:
            sources.append(Source(name, root.rstrip("/") or "/", priority))
    names = [s.name for s in sources]
    wrong += [f"source {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    library = data.get("library", "")
    if not isinstance(library, str) or not library.startswith("/"):
        wrong.append("library: an absolute path is needed")
        library = ""
    wrong += [f"source {s.name} overlaps the library" for s in sources if library and overlap(s.root, library)]
    wrong += [f"sources {a.name} and {b.name} overlap" for i, a in enumerate(sources) for b in sources[i + 1 :] if overlap(a.root, b.root)]
    scan = _section(Scan, data.get("scan", {}), "scan", wrong)
    extensions = tuple(e.lower() for e in scan.extensions if isinstance(e, str))
    wrong += [f"scan.extensions: {e} begins without a point" for e in extensions if not e.startswith(".") or len(e) < 2]
    dates = _section(Dates, data.get("dates", {}), "dates", wrong)
    if dates.least_year > dates.most_year or dates.sequence_gap < 1 or dates.time_gap_hours < 0:
        wrong.append("dates: the years or gaps are out of range")
    keeper, imports = data.get("keeper", {}), data.get("imports", {})
    prefer, overrides = tuple(keeper.get("prefer", PREFERENCES)), keeper.get("overrides", {})
    wrong += [f"keeper.prefer: {p} is no preference" for p in prefer if p not in PREFERENCES]
    wrong += [f"keeper.overrides: no source {n}" for n in overrides if n not in names]
    directories, template = imports.get("directories", {}), imports.get("template", "{year}/{original_name}")
    wrong += [f"imports.directories: no source {n}" for n in directories if n not in names]
    base = imports.get("default_directory", "Imported")
    for d in (base, *directories.values()):
        if not isinstance(d, str) or d.startswith("/") or not d or {"", ".", ".."} & set(d.split("/")):
            wrong.append(f"imports: {d!r} is no safe relative folder")
    try:
        used = [f for _, f, _, _ in string.Formatter().parse(template) if f is not None]
        wrong += [f"imports.template: no field {f}" for f in used if f not in TEMPLATE_FIELDS]
    except ValueError as error:
        wrong.append(f"imports.template: {error}")
    if wrong:
        raise ConfigError("; ".join(wrong))
    scan = Scan(scan.directories, scan.prefixes, scan.suffixes, extensions)
    return Config(tuple(sources), library, scan, dates, prefer, dict(overrides), base, dict(directories), template)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
