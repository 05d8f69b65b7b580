"""Settings of code lookup and portfolio matching, saved queries, and named stores, as JSON on the driver."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import codes
from ..operators.filters import Clause
from ..sources import files
from ..sources.code_api import CodeService, Transport

CACHE = "patent_id string, cpc_codes array<string>, fetched_at double"


@dataclass
class Source:
    """Where codes come from: a local file, or a service whose key stands in an environment variable and is never stored."""

    type: str = "local_file"
    path: str = ""
    patent_column: str = "patent_id"
    code_column: str = "cpc_group"
    endpoint: str = ""
    api_key_env: str = ""
    patent_query_field: str = "applicationMetaData.patentNumber"
    cpc_response_field: str = "applicationMetaData.cpcClassificationBag"
    batch_size: int = 100
    rate_limit_per_min: int = 45
    max_api_calls: int = 1000
    retries: int = 3
    offline_only: bool = True


@dataclass
class Cache:
    path: str = ""
    ttl_days: int = 30


@dataclass
class Match:
    grain: str = "subclass"
    overlap_metric: str = "shared_count"
    overlap_threshold: float = 1.0
    min_in_domain_patents: int = 1
    hit_rate_floor: float = 0.5
    weight_overlap: float = 1.0
    weight_recency: float = 1.0
    weight_volume: float = 1.0

    def __post_init__(self) -> None:
        for name, allowed in (("grain", ("subclass", "main_group", "full_symbol")), ("overlap_metric", ("shared_count", "jaccard", "rarity_weighted"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} {getattr(self, name)!r} isn't one of {', '.join(allowed)}")

    def rules(self) -> codes.MatchConfig:
        return codes.MatchConfig(self.grain, self.overlap_metric, self.overlap_threshold, self.min_in_domain_patents, self.hit_rate_floor, self.weight_overlap, self.weight_volume, self.weight_recency)


def _of(kind: type, data: dict[str, Any]) -> Any:
    """The known fields of an object, each brought to its default's type."""
    found = {}
    for f in fields(kind):
        if f.name in data:
            found[f.name] = type(f.default)(data[f.name]) if not isinstance(data[f.name], type(f.default)) else data[f.name]
    return kind(**found)


@dataclass
class Config:
    source: Source = field(default_factory=Source)
    cache: Cache = field(default_factory=Cache)
    match: Match = field(default_factory=Match)

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Config:
        return Config(_of(Source, data.get("source", {})), _of(Cache, data.get("cache", {})), _of(Match, data.get("match", {})))

    @staticmethod
    def load(path: str) -> Config:
        """The defaults where there is no such file."""
        return Config.from_dict(json.loads(Path(path).read_text(encoding="utf-8"))) if Path(path).is_file() else Config()

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")


def make_source(spark: SparkSession, config: Source, transport: Transport | None = None) -> CodeService | DataFrame | None:
    """The service, or the rows (patent_id, cpc) of a local file; None if nothing is set up."""
    if config.type != "local_file":
        if transport is None:
            return None
        return CodeService(config.endpoint, os.environ.get(config.api_key_env, ""), transport, config.batch_size, config.rate_limit_per_min / 60, config.retries, config.max_api_calls, patent_field=config.patent_query_field, code_field=config.cpc_response_field)
    return files.read_codes(spark, config.path, config.patent_column, config.code_column) if config.path else None


@dataclass
class Context:
    """What code lookup of a run needs; the network is used only if allowed here and by the settings."""

    config: Config = field(default_factory=Config)
    allow_network: bool = False
    transport: Transport | None = None
    now: float | None = None

    def resolve(self, spark: SparkSession, ids: DataFrame) -> DataFrame:
        """patent_id, cpc_codes (null: not looked up), status of distinct ids: the cache's fresh entries first, then the
        source; what that says is kept in the cache."""
        now, path = self.now or time.time(), self.config.cache.path
        cache = spark.read.schema(CACHE).parquet(path) if path and Path(path).exists() else spark.createDataFrame([], CACHE)
        source = make_source(spark, self.config.source, self.transport if self.allow_network else None)
        ttl = self.config.cache.ttl_days * 86400.0
        if isinstance(source, CodeService):
            fresh = cache if ttl <= 0 else cache.filter(f"{now} - fetched_at < {ttl}")
            # The service's own budget of calls bounds what it is asked for, and so this list.
            most = self.config.source.max_api_calls * self.config.source.batch_size
            asked = [r[0] for r in ids.select("patent_id").distinct().join(fresh, "patent_id", "left_anti").limit(most + 1).collect()]
            if len(asked) > most:
                raise RuntimeError(f"more than {most} patents would be asked for; use a local file")
            answers = source.fetch(asked)
            source = spark.createDataFrame([(i, c) for i, found in answers.items() for c in found], "patent_id string, cpc string")
        found, merged = codes.resolve_cached(ids, cache, source, now, ttl)
        if path and source is not None:
            rows = codes.checkpointed(merged.select("patent_id", "cpc_codes", "fetched_at"))  # read from the folder that it goes to
            rows.write.mode("overwrite").parquet(path)
            found, _ = codes.resolve_cached(ids, spark.read.schema(CACHE).parquet(path), None, now, ttl)
        return codes.checkpointed(found)  # later lookups replace the cache's files


# --- saved queries


@dataclass
class Query:
    name: str
    table: str = "flat"
    columns: list[str] | None = None
    combine: str = "and"
    search: str = ""
    clauses: list[Clause] = field(default_factory=list)
    sort: tuple[str, bool] | None = None

    @staticmethod
    def from_dict(data: dict[str, Any]) -> Query:
        known = {f.name for f in fields(Query)}
        rest = {k: v for k, v in data.items() if k in known and k not in ("clauses", "sort")}
        return Query(**rest, clauses=[Clause(**c) for c in data.get("clauses", [])], sort=(str(data["sort"][0]), bool(data["sort"][1])) if data.get("sort") else None)


def dump_queries(queries: list[Query], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([asdict(q) for q in queries], indent=2, ensure_ascii=False), encoding="utf-8")


def load_queries(path: str) -> list[Query]:
    return [Query.from_dict(q) for q in json.loads(Path(path).read_text(encoding="utf-8"))] if Path(path).is_file() else []


class Stores:
    """Named JSON documents in a folder: queries, templates, settings, recent inputs; the memory may lie elsewhere."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def path(self, name: str) -> Path:
        return self.folder / f"{name}.json"

    def get(self, name: str, default: Any = None) -> Any:
        return json.loads(self.path(name).read_text(encoding="utf-8")) if self.path(name).is_file() else default

    def put(self, name: str, value: Any) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self.path(name).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")

    def memory_path(self) -> str:
        return self.get("settings", {}).get("memory_path") or str(self.path("memory"))

    def move_memory(self, path: str) -> None:
        self.put("settings", self.get("settings", {}) | {"memory_path": path})

    def recent(self, path: str | None = None, most: int = 10) -> list[str]:
        """The inputs used last; a path comes to the front."""
        known = self.get("recent", [])
        if path:
            known = [path, *(p for p in known if p != path)][:most]
            self.put("recent", known)
        return known
