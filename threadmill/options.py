"""The options of an engine as a TOML file: where the store is, which logs it reads, what it must not keep, who summarizes.

Missing parts take their defaults and unknown ones are kept, so that a file outlives the version that wrote it.
"""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

VERSION, FAMILIES = 2, ("claude", "codex")
#: Whose summarizer goes first: a family's, or that of the session itself.
PREFERENCES, PREFERRED = (*FAMILIES, "same"), "claude"


@dataclass
class Options:
    store: str
    sources: dict[str, list[str]] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    prefer: str = PREFERRED
    summarizers: dict[str, dict] = field(default_factory=dict)

    def engine(self, spark: SparkSession):
        from threadmill.engine import Engine

        return Engine(spark, self.store, [(f, roots) for f, roots in self.sources.items() if roots], self.exclude, self.prefer)


def _value(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_value, x)) + "]"
    return json.dumps(x, ensure_ascii=False) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def dumps(o: Options) -> str:
    """The options as TOML."""
    tables = {
        "store": {"root": o.store}, "exclude": {"globs": o.exclude}, "summarizer": {"prefer": o.prefer},
        **{f"sources.{f}": {"roots": roots} for f, roots in o.sources.items()}, **{f"summarizer.{f}": d for f, d in o.summarizers.items()}}
    lines = [f"version = {VERSION}"]
    for name, entries in tables.items():
        lines += ["", f"[{name}]", *(f"{k} = {_value(v)}" for k, v in entries.items())]
    return "\n".join(lines) + "\n"


def loads(text: str, store: str) -> Options:
    """Options from TOML; ``store`` is where they keep the store if the text doesn't say."""
    raw = tomllib.loads(text)
    told = raw.get("summarizer", {})
    prefer = told.get("prefer") if told.get("prefer") in PREFERENCES else PREFERRED
    sources = {f: list(s.get("roots", [])) for f, s in raw.get("sources", {}).items() if f in FAMILIES and s.get("enabled", True)}
    own = {f: d for f, d in told.items() if isinstance(d, dict)}
    return Options(raw.get("store", {}).get("root") or store, sources, list(raw.get("exclude", {}).get("globs", [])), prefer, own)


def load(path: str, store: str, found: dict[str, list[str]] | None = None) -> Options:
    """Options from a file; where there is none, those of the log folders ``found`` that exist are written to it. An older file is
    brought to this version; where it can't be written it is used as it is."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        options, old = loads(text, store), tomllib.loads(text).get("version", 1) < VERSION
    else:
        options, old = Options(store, {f: [r for r in roots if os.path.isdir(r)] for f, roots in (found or {}).items()}), True
    if old:
        try:
            save(path, options)
        except OSError:
            pass
    return options


def save(path: str, options: Options) -> None:
    """Write a file beside it and move that into place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(dumps(options))
    os.replace(f"{path}.new", path)
