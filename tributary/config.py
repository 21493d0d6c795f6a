"""Run configuration from a mapping or a YAML file.

``SECTIONS`` says of each section which fields it has, of what type and range, and
what holds where they are not given.  ``read`` goes by that table alone; what
concerns several fields together is in ``_agree``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from tributary.schema import Keys, Link

# Types of tasks and of columns.
TASK_TYPES = ("regression", "binary_classification", "multiclass_classification", "multilabel_classification", "recommendation")
SEMANTIC_TYPES = ("numerical", "categorical", "multicategorical", "timestamp", "text_embedded", "embedding")

_NEEDED = object()


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """A field: its type, what holds without it, bounds (``low`` included, ``high`` not), choices, and whether it is a list."""

    kind: type
    default: object = _NEEDED
    low: float | None = None
    high: float | None = None
    above: float | None = None
    choices: tuple[str, ...] = ()
    many: bool = False

    def accepts(self, value: object) -> bool:
        if self.kind is float:
            fits = isinstance(value, (int, float)) and not isinstance(value, bool)
        elif self.kind is int:
            fits = isinstance(value, int) and not isinstance(value, bool)
        elif self.kind is str:
            fits = isinstance(value, str) and value.strip() != ""
        else:
            fits = isinstance(value, self.kind)
        if not fits or self.choices and value not in self.choices:
            return False
        return not (self.low is not None and value < self.low or self.high is not None and value >= self.high or self.above is not None and value <= self.above)

    def read(self, value: object, path: str) -> object:
        if value is None and self.default is None:
            return None
        items = (list(value) if isinstance(value, (list, tuple)) else [value]) if self.many else [value]
        if not items and self.default is _NEEDED or not all(map(self.accepts, items)):
            limits = {k: v for k, v in (("from", self.low), ("above", self.above), ("below", self.high), ("of", self.choices)) if v not in (None, ())}
            raise ConfigError(f"{path}: {value!r} is no {'list of ' * self.many}{self.kind.__name__} {limits or ''}")
        items = [x.strip() if isinstance(x, str) else x for x in items]
        return tuple(items) if self.many else items[0]


_TEXT, _MAYBE = Field(str), Field(str, None)
_NAMES = Field(str, many=True)
_COUNT = Field(int, None, low=1)

SECTIONS: dict[str, dict[str, Field]] = {
    "config": {"database": Field(Mapping), "task": Field(Mapping), "schema": Field(Mapping, {}), "hidden_columns": Field((list, tuple), (), many=True), "features": Field(Mapping, (), many=True), "sampling": Field(Mapping, {}), "model": Field(Mapping, {}), "training": Field(Mapping, {}), "report": Field((str, Mapping), None)},
    "database": {"url": _MAYBE, "url_env": _MAYBE, "path": _MAYBE, "reader": _MAYBE},
    "schema": {"identity_keys": Field(Mapping, {}), "foreign_keys": Field(Mapping, (), many=True), "time_columns": Field(Mapping, {})},
    "foreign_key": {"table": _TEXT, "columns": _NAMES, "target": _TEXT, "target_columns": Field(str, (), many=True)},
    "task": {"name": _MAYBE, "table": _TEXT, "type": Field(str, choices=TASK_TYPES), "entity_table": _TEXT, "entity_columns": _NAMES, "target": _TEXT, "key": _NAMES, "time": _MAYBE, "destination_table": _MAYBE, "destination_columns": Field(str, (), many=True), "split": Field(Mapping, {})},
    "split": {"type": Field(str, None, choices=("column", "sql_query", "default")), "column": _MAYBE, "values": Field(Mapping, {}), "queries": Field(Mapping, {}), "fraction": Field(float, 0.2, above=0, high=1), "seed": Field(int, 42, low=0)},
    "feature": {"table": _TEXT, "column": _TEXT, "semantic_type": Field(str, choices=SEMANTIC_TYPES), "processor": _MAYBE, "params": Field(Mapping, {})},
    "sampling": {"batch_size": Field(int, 512, low=1), "num_neighbors": Field(int, (128, 128), low=1, many=True), "epochs": Field(int, 1, low=1), "seed": Field(int, 42, low=0), "max_batches": _COUNT, "block_rows": Field(int, 4096, low=1)},
    "model": {"channels": Field(int, 128, low=1), "layers": Field(int, 2, low=1), "aggregation": Field(str, "sum", choices=("sum", "mean", "max")), "dropout": Field(float, 0.0, low=0, high=1)},
    "training": {"epochs": Field(int, 10, low=1), "learning_rate": Field(float, 0.005, above=0), "weight_decay": Field(float, 0.0, low=0), "patience": _COUNT, "seed": Field(int, 42, low=0)},
    "report": {"path": _TEXT, "format": Field(str, "jsonl", choices=("jsonl", "csv"))},
}


def read(section: str, value: object, path: str | None = None) -> dict[str, object]:
    """The fields of a section, checked, with defaults; fields it does not know and missing ones raise."""
    path, fields = path or section, SECTIONS[section]
    if not isinstance(value, Mapping):
        raise ConfigError(f"{path}: a mapping is needed")
    strange = sorted(set(value) - set(fields))
    absent = [n for n, f in fields.items() if f.default is _NEEDED and n not in value]
    if strange or absent:
        raise ConfigError(f"{path}: unknown fields {strange}, missing fields {absent}")
    out = {n: f.read(value[n], f"{path}.{n}") if n in value else f.default for n, f in fields.items()}
    _agree(section, out, path)
    return out


def _agree(section: str, v: dict, path: str) -> None:
    """What must hold between the fields of a section."""
    wrong = None
    if section == "database" and sum(v[k] is not None for k in ("url", "url_env", "path")) != 1:
        wrong = "exactly one of url, url_env and path is needed"
    elif section == "task" and (v["type"] == "recommendation") != (v["destination_table"] is not None):
        wrong = "destination_table is for recommendation tasks, and only for those"
    elif section == "split":
        asked = set(v["queries"])
        labels = [str(x) for x in v["values"].values()]
        kind = "column" if v["column"] else "sql_query" if asked else "default"
        if v["type"] not in (None, kind) or v["column"] and asked or bool(v["column"]) != bool(labels):
            wrong = "give column and values, or queries, or neither"
        elif len(set(labels)) < len(labels) or not all(Field(int).accepts(x) or Field(str).accepts(x) for x in v["values"].values()):
            wrong = "values are texts or integers, each once"
        elif asked and asked not in ({"test"}, {"train", "validation", "test"}) or not all(map(_TEXT.accepts, v["queries"].values())):
            wrong = "queries are of test alone, or of train, validation and test"
    if wrong:
        raise ConfigError(f"{path}: {wrong}")


@dataclass(frozen=True)
class DatabaseConfig:
    url: str
    reader: str | None = None


@dataclass(frozen=True)
class SplitConfig:
    """By ``column`` and ``values``, by ``queries``, or by default with ``fraction`` and ``seed``."""

    column: str | None = None
    values: Mapping[str, object] = field(default_factory=dict)
    queries: Mapping[str, str] = field(default_factory=dict)
    fraction: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class TaskConfig:
    table: str
    task_type: str
    entity_table: str
    entity_columns: tuple[str, ...]
    target: str
    key: tuple[str, ...]
    time: str | None = None
    destination_table: str | None = None
    destination_columns: tuple[str, ...] = ()
    split: SplitConfig = SplitConfig()
    name: str | None = None


@dataclass(frozen=True)
class FeatureConfig:
    table: str
    column: str
    semantic_type: str
    processor: str | None = None
    params: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class SamplingConfig:
    batch_size: int = 512
    num_neighbors: tuple[int, ...] = (128, 128)
    epochs: int = 1
    seed: int = 42
    max_batches: int | None = None
    block_rows: int = 4096


@dataclass(frozen=True)
class RunConfig:
    """``model`` and ``training`` are for the trainer that takes the batches; nothing here reads them."""

    database: DatabaseConfig
    schema: Keys
    hidden: tuple[tuple[str, str], ...]
    task: TaskConfig
    features: tuple[FeatureConfig, ...] = ()
    sampling: SamplingConfig = SamplingConfig()
    report: Mapping[str, object] | None = None
    model: Mapping[str, object] = field(default_factory=dict)
    training: Mapping[str, object] = field(default_factory=dict)


def _database(v: dict, base: Path) -> DatabaseConfig:
    url = v["url"] or v["path"]
    if v["url_env"]:
        url = os.environ.get(v["url_env"])
        if not url:
            raise ConfigError(f"database.url_env: {v['url_env']} is not set")
    elif v["path"] and "://" not in url and not os.path.isabs(url):
        url = str(base / url)
    return DatabaseConfig(url, v["reader"])


def _keys(v: dict) -> Keys:
    links = []
    for i, item in enumerate(v["foreign_keys"]):
        x = read("foreign_key", item, f"schema.foreign_keys[{i}]")
        links.append(Link(x["table"], x["columns"], x["target"], x["target_columns"]))
    ids = {t: _NAMES.read(k, f"schema.identity_keys.{t}") for t, k in v["identity_keys"].items()}
    return Keys(ids, tuple(links), {t: _TEXT.read(c, f"schema.time_columns.{t}") for t, c in v["time_columns"].items()})


def parse_config(value: object, base: str | Path = ".") -> RunConfig:
    v = read("config", value)
    t = read("task", v["task"])
    s = read("split", t.pop("split"), "task.split")
    s.pop("type")
    features = [FeatureConfig(**read("feature", item, f"features[{i}]")) for i, item in enumerate(v["features"])]
    if len({(f.table, f.column) for f in features}) < len(features):
        raise ConfigError("features: a column comes twice")
    hidden = [_NAMES.read(p, "hidden_columns") for p in v["hidden_columns"]]
    if any(len(p) != 2 for p in hidden):
        raise ConfigError("hidden_columns: pairs of table and column are needed")
    report = {"path": v["report"]} if isinstance(v["report"], str) else v["report"]
    return RunConfig(
        _database(read("database", v["database"]), Path(base)), _keys(read("schema", v["schema"])), tuple(hidden),
        TaskConfig(task_type=t.pop("type"), split=SplitConfig(**s), **t), tuple(features), SamplingConfig(**read("sampling", v["sampling"])),
        report and read("report", report), read("model", v["model"]), read("training", v["training"]),
    )


def load_config(path: str | Path) -> RunConfig:
    """From a YAML file (or JSON where no YAML library is installed)."""
    content = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        value = yaml.safe_load(content)
    except ImportError:
        value = json.loads(content)
    return parse_config(value, Path(path).parent)
