"""Knowledge packs: full JSON or TOML documents, or simple JSON lists."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from echolith import schemas

BUILT_IN = Path(__file__).with_name("pack_data")
_ORDER = ["docker", "git", "linux", "cargo", "go", "kubernetes"]


def _text(value: object) -> str:
    if not isinstance(value, str):
        raise ValueError("a text is missing")
    return value


def _full(doc: object) -> dict:
    """A pack with its defaults; raises ValueError or KeyError if a required field is missing."""
    if not isinstance(doc, dict) or not isinstance(doc.get("entries"), list):
        raise ValueError("not a pack")
    entries = []
    for e in doc["entries"]:
        flags = [{"flag": _text(f["flag"]), "description": _text(f["description"])} for f in e.get("flags", [])]
        entries.append({k: _text(e[k]) for k in ("command", "description", "category", "topic")} | {"aliases": [_text(a) for a in e.get("aliases", [])], "flags": flags, "examples": [_text(x) for x in e.get("examples", [])], "difficulty": int(e.get("difficulty", 1))})
    return {"topic": _text(doc["topic"]), "description": _text(doc["description"]), "version": doc.get("version", "1.0"), "entries": entries}


def _simple(doc: object, stem: str) -> dict:
    if not isinstance(doc, list):
        raise ValueError("not a list of entries")
    if not doc:
        raise LookupError("empty entries array")
    topic = stem.lower()
    entries = []
    for e in doc:
        alias = e.get("query")
        entries.append({"command": _text(e["command"]), "description": _text(e["description"]), "category": e.get("category") or "general", "topic": e.get("topic") or topic, "aliases": [alias] if alias else [], "flags": [], "examples": [], "difficulty": 1})
    return {"topic": stem, "description": f"Custom: {stem}", "version": "1.0", "entries": entries}


def _load(path: Path) -> tuple[dict, bool]:
    """(pack, whether it is a simple one); all or nothing."""
    if path.suffix == ".toml":
        return _full(tomllib.loads(path.read_text())), False
    doc = json.loads(path.read_text())
    try:
        return _full(doc), False
    except (ValueError, KeyError, TypeError, AttributeError):
        return _simple(doc, path.stem), True


class Knowledge:
    """``entries``, ``packs`` (topic, description, simple, load_order, source, entry count) and the load ``errors``.

    Packs are small documents written by people; they are read on the driver, in the order built-in, then
    own files by name.
    """

    def __init__(self, spark: SparkSession, user_dir: str | None = None, built_in: bool = True):
        files = [BUILT_IN / f"{name}.json" for name in _ORDER] if built_in else []
        own = sorted(p for p in Path(user_dir).iterdir() if p.is_file() and p.suffix in (".json", ".toml")) if user_dir and Path(user_dir).is_dir() else []
        entries, packs, self.errors = [], [], []
        for at, path in enumerate([*files, *own]):
            try:
                pack, simple = _load(path)
            except (ValueError, KeyError, TypeError, AttributeError, LookupError, OSError) as error:
                self.errors.append(f"{path}: {error}")
                continue
            source = "builtin" if path in files else str(path)
            packs.append((pack["topic"], pack["description"], simple, at, source, len(pack["entries"])))
            entries += [(len(entries) + i, e["command"], e["description"], e["category"], e["topic"], e["aliases"], [(f["flag"], f["description"]) for f in e["flags"]], e["examples"], e["difficulty"], source) for i, e in enumerate(pack["entries"])]
        self.entries: DataFrame = spark.createDataFrame(entries, schemas.KNOWLEDGE)
        self.packs: DataFrame = spark.createDataFrame(packs, "topic string, description string, simple boolean, load_order int, source string, entries int")
