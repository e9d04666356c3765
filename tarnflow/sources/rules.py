"""Rule files that operators keep by hand: aliases, builds' rules and corrections of ids. They are small, read on the driver through the file
system of their path, checked whole, and refused whole: a rule passed over would look like no rule."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from tarnflow.operators import arbitration, resolver

#: What was read, by path and kind, with the file's state then; files named at once are few.
_HELD: dict[tuple[str, str], tuple[tuple[int, int], Any]] = {}
_AS_MANY = 32


def _read(spark: SparkSession, path: str, kind: str, made: Callable[[dict, str], Any]) -> Any:
    """What `made` makes of the file, held until the file's time or length changes. A file that is refused is read again the next time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        raise FileNotFoundError(f"the rule file {path} isn't there")
    state = fs.getFileStatus(at)
    identity = (state.getModificationTime(), state.getLen())
    held = _HELD.get((path, kind))
    if held and held[0] == identity:
        return held[1]
    found = made(_mapping("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()), path), path)  # one small file
    if len(_HELD) >= _AS_MANY:
        _HELD.clear()
    _HELD[(path, kind)] = (identity, found)
    return found


def _mapping(text: str, path: str) -> dict:
    """The document of a YAML or JSON file, which must be a mapping; nothing at all is an empty one."""
    try:
        try:
            found = json.loads(text or "{}")
        except ValueError:
            import yaml

            try:
                found = yaml.safe_load(text)
            except yaml.YAMLError as e:
                raise ValueError(f"{path} can't be read: {e}") from e
    except ImportError as e:
        raise ValueError(f"{path} is no JSON, and YAML needs the package yaml") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds {type(found).__name__}, not a mapping")
    return found


def _aliases(found: dict, path: str) -> dict[str, list[str]]:
    for stig_id, phrases in found.items():
        if not isinstance(phrases, list) or any(not isinstance(p, str) or not p.strip() for p in phrases):
            raise ValueError(f"{path}: aliases of {stig_id} are {phrases!r}, not a list of phrases")
    return found


def _pattern(value: Any, what: str) -> re.Pattern:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{what} is {value!r}, not a pattern")
    try:
        return re.compile(value, re.IGNORECASE)
    except re.error as e:
        raise ValueError(f"{what} {value!r} is no pattern: {e}") from e


def _steps(rows: Any, what: str) -> list[tuple[int, str | None]]:
    if not isinstance(rows, list) or not rows:
        raise ValueError(f"{what}: a list of thresholds is needed")
    steps = []
    for row in rows:
        if not isinstance(row, dict) or "min" not in row or "version" not in row:
            raise ValueError(f"{what}: threshold {row!r} needs min and version; version: null says that no benchmark applies")
        least, version = row["min"], row["version"]
        if isinstance(least, bool) or not re.fullmatch(r"\d+", str(least)):
            raise ValueError(f"{what}: min {least!r} is no number")
        if version is not None and not isinstance(version, str):
            raise ValueError(f"{what}: version {version!r} must be a text or null, since versions are stored as texts")
        steps.append((int(least), version))
    if 0 not in [least for least, _ in steps]:
        raise ValueError(f"{what}: no threshold has min 0, so low builds would meet none")
    if len({least for least, _ in steps}) < len(steps):
        raise ValueError(f"{what}: two thresholds have one min")
    return sorted(steps, key=lambda s: -s[0])


def _entries(found: dict, path: str) -> list[tuple[str, str, str, list[tuple[int, str | None]]]]:
    entries = []
    for name, entry in found.items():
        what = f"{path}: entry {name}"
        if not isinstance(entry, dict):
            raise ValueError(f"{what} is {entry!r}, not a mapping")
        _pattern(entry.get("id_pattern"), f"{what}: id_pattern")
        if "n" not in _pattern(entry.get("build_pattern"), f"{what}: build_pattern").groupindex:
            raise ValueError(f"{what}: build_pattern has no group named n")
        entries.append((name, entry["id_pattern"], entry["build_pattern"], _steps(entry.get("thresholds"), what)))
    return entries


def _corrections(found: dict, path: str) -> tuple[arbitration.Corrections, dict[str, str]]:
    pairs, titles = {}, {}
    for stig_id, entry in found.items():
        documents = entry.get("documents") if isinstance(entry, dict) else None
        if not isinstance(documents, list) or not all(isinstance(d, dict) for d in documents):
            raise ValueError(f"{path}: correction of {stig_id} needs a list of documents, each a mapping")
        pairs[stig_id] = [(d.get("match"), d.get("stig_id")) for d in documents]
        for d in documents:
            if not isinstance(d.get("title"), str) or not d["title"].strip():
                raise ValueError(f"{path}: a document of {stig_id} has title {d.get('title')!r}")
    try:
        arbitration.checked(pairs)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    for entry in found.values():
        for d in entry["documents"]:
            if titles.setdefault(d["stig_id"], d["title"]) != d["title"]:
                raise ValueError(f"{path}: two titles for {d['stig_id']}")
    return pairs, titles


def aliases(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Benchmark id -> phrases. What is returned may be changed by the caller; what is held is not."""
    return {k: list(v) for k, v in _read(spark, path, "aliases", _aliases).items()}


def entries(spark: SparkSession, path: str) -> list[tuple[str, str, str, list[tuple[int, str | None]]]]:
    """(name, id pattern, build pattern, thresholds from the highest) in the file's order."""
    return [(n, i, b, list(s)) for n, i, b, s in _read(spark, path, "entries", _entries)]


def corrections(spark: SparkSession, path: str) -> tuple[arbitration.Corrections, dict[str, str]]:
    """(published id -> (part of a path, corrected id) of each document; corrected id -> title)."""
    pairs, titles = _read(spark, path, "corrections", _corrections)
    return {k: list(v) for k, v in pairs.items()}, dict(titles)


def rules(spark: SparkSession, alias_file: str | None = None, entry_file: str | None = None) -> resolver.Rules:
    """The resolver's rules of both files."""
    return resolver.Rules(aliases(spark, alias_file) if alias_file else {}, entries(spark, entry_file) if entry_file else []).checked()
