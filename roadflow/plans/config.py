"""Run configuration from a JSON file with kebab-case keys."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Settings of a recorded run; durations in microseconds."""

    departure_time: str = "2021-01-01 00:00:00"
    round_us: int = 5_000_000
    tolerance_us: int = 5_000_000
    map_update_us: int = 1_000_000
    k_alternatives: int = 1
    travel_time_limit: float | None = 0.0
    seed: int = 0
    stuck_rounds: int = 0
    plateau_default_route: bool = False


def _rest(*shares: float) -> float:
    rest = round(1 - sum(shares), 2)
    if rest < 0:
        raise ValueError("ratios add up to more than 1")
    return rest


@dataclass(frozen=True)
class AlternativesRatio:
    dijkstra_fastest: float = 0.0
    dijkstra_shortest: float = 0.0
    plateau_fastest: float = 0.0

    def as_list(self) -> list[float]:
        shares = [self.dijkstra_fastest, self.dijkstra_shortest, self.plateau_fastest]
        return [_rest(*shares), *shares]


@dataclass(frozen=True)
class SelectionRatio:
    first: float = 0.0
    random: float = 0.0
    ptdr: float = 0.0

    def as_list(self) -> list[float]:
        shares = [self.first, self.random, self.ptdr]
        return [_rest(*shares), *shares]


@dataclass(frozen=True)
class RunConfig:
    vehicles_path: str
    settings: Settings = field(default_factory=Settings)
    alternatives: AlternativesRatio = field(default_factory=AlternativesRatio)
    selection: SelectionRatio = field(default_factory=SelectionRatio)
    out: str = "simulation-record"
    speeds_path: str | None = None
    max_records_per_file: int = 1_000_000_000


def _ratio(kind, values: dict):
    names = kind.__dataclass_fields__
    return kind(**{k.replace("-", "_"): v for k, v in values.items() if k.replace("-", "_") in names})


def load_config(path: str, workdir: str | None = None) -> RunConfig:
    """Read the file; empty texts mean "not set", seconds become microseconds."""
    with open(path) as f:
        data = json.load(f)
    run = {k.replace("_", "-"): v for k, v in next((v for k, v in data.items() if k.endswith("simulator")), {}).items()}
    vehicles = data.get("run", {}).get("vehicles-path")
    if not vehicles:
        raise ValueError("vehicles path not set")
    vehicles = os.path.join(workdir, vehicles) if workdir else vehicles

    def us(key: str, default_s: float) -> int:
        return round(run.get(key, default_s) * 1_000_000)

    settings = Settings(
        departure_time=run.get("departure-time", Settings.departure_time),
        round_us=us("round-frequency-s", 5), tolerance_us=us("los-vehicles-tolerance-s", 5), map_update_us=us("map-update-freq-s", 1),
        k_alternatives=run.get("k-alternatives", 1), travel_time_limit=run.get("travel-time-limit-perc", 0.0),
        seed=run.get("seed") or 0, stuck_rounds=run.get("stuck-detection", 0), plateau_default_route=run.get("plateau-default-route", False),
    )
    return RunConfig(
        vehicles, settings, _ratio(AlternativesRatio, data.get("alternatives", {})), _ratio(SelectionRatio, data.get("route-selection", {})),
        run.get("out", RunConfig.out), run.get("speeds-path") or None,
        run.get("max-records-per-file", RunConfig.max_records_per_file),
    )
