"""What a scan may be told: names, defaults and hard limits, as an object and as a column."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hard limits of the settings; each must be at least one, but for the depth, which may be left open.
LIMITS = {
    "max_errors": 1_000, "max_files": 10_000_000, "max_file_bytes": 1 << 30, "max_total_bytes": 16 << 40, "max_depth": 1_024, "max_cache_bytes": 16 << 30, "max_parser_diagnostics": 100_000,
    "max_facts_per_file": 100_000, "max_total_facts": 10_000_000, "max_graph_nodes": 10_000_000, "max_graph_edges": 20_000_000, "max_interprocedural_depth": 32, "max_findings": 1_000_000,
}
MAX_SUPPRESSIONS, MAX_RULE, MAX_TEXT = 10_000, 32, 1_024


def problem(name: Column, value: Column) -> Column:
    """What is wrong with a setting, or null. A null value is one left open."""
    limit = F.coalesce(*[F.when(name == k, F.lit(v).cast("long")) for k, v in LIMITS.items()])
    return F.when(limit.isNull(), "unknown setting").when(value < 1, "must be greater than zero").when(value > limit, F.concat(F.lit("cannot exceed "), limit.cast("string")))


def suppression_problem(rule: str, path: str, reason: str) -> str | None:
    """Of a suppression as it is read; those that are well formed but match nothing are diagnostics of the scan."""
    parts = path.split("/")
    control = any(ord(c) < 32 or 127 <= ord(c) < 160 for c in path + reason)
    if not rule or len(rule.encode()) > MAX_RULE or not path or len(path.encode()) > MAX_TEXT or not reason or len(reason.encode()) > MAX_TEXT:
        return "values must be bounded"
    return "values must be repository-relative" if path.startswith("/") or "\\" in path or ".." in parts or control else None


@dataclass(frozen=True)
class Settings:
    max_errors: int = 100
    max_files: int = 1_000_000
    max_file_bytes: int = 1 << 20
    max_total_bytes: int = 16 << 40
    max_depth: int | None = None
    max_cache_bytes: int = 1 << 30
    max_parser_diagnostics: int = 10_000
    max_facts_per_file: int = 10_000
    max_total_facts: int = 10_000_000
    max_graph_nodes: int = 10_000_000
    max_graph_edges: int = 20_000_000
    max_interprocedural_depth: int = 4
    max_findings: int = 1_000_000
    include_hidden: bool = False
    include_vendor: bool = False
    include_generated: bool = False
    exclude: tuple[str, ...] = ()
    suppressions: tuple[tuple[str, str, int, str], ...] = field(default=())

    def __post_init__(self):
        for f in fields(self):
            limit, value = LIMITS.get(f.name), getattr(self, f.name)
            if limit is None or value is None and f.name == "max_depth":
                continue
            if not isinstance(value, int) or value < 1 or value > limit:
                raise ValueError(f"{f.name} must be between 1 and {limit}")
        if len(self.suppressions) > MAX_SUPPRESSIONS:
            raise ValueError(f"suppressions cannot exceed {MAX_SUPPRESSIONS} entries")
        for rule, path, _, reason in self.suppressions:
            if wrong := suppression_problem(rule, path, reason):
                raise ValueError(f"suppression {wrong}")
