"""Named parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

SLICE_SECONDS = 300
SLICES_PER_DAY = 288
DAY_SECONDS = 86400

# Road class id, priority. Every class has the same default speed.
ROAD_CLASS_PRIORITY = (
    (100, 1.30), (101, 1.00), (102, 1.10), (104, 1.04), (105, 1.12), (106, 1.08), (107, 1.15),
    (108, 1.10), (109, 1.20), (110, 1.12), (111, 1.25), (112, 1.30), (113, 1.50), (114, 1.75),
    (117, 1.30), (118, 1.30), (119, 1.30), (120, 1.30), (122, 1.30), (123, 1.30), (124, 1.30),
    (125, 1.30), (201, 1.30), (202, 1.30), (301, 1.30), (303, 1.30), (304, 1.30), (305, 1.30),
)
ROAD_CLASS_MAXSPEED = 33


@dataclass(frozen=True)
class TrafficParams:
    """Speeds are m/s, times are seconds."""

    max_speed: float = 33.33
    min_speed: float = 1.5
    default_speed: float = 10.0
    jam_speed: float = 2.0
    jam_decay: float = 0.9
    min_gap: int = 10
    max_gap: int = 600
    smooth_base: float = 0.9
    smooth_step: float = 0.1
    history_keep: float = 0.8
    turning_default: float = 4.0
    turning_floor: float = 0.1
    late_slices: int = 1
    infer_slices: int = 2
    infer_factor: float = 0.8
    # Weight kept for a sample one slice late; 0.0 overwrites the state.
    late_alpha: float = 0.0
    cost_limit_ms: int = 25 * 60 * 1000


@dataclass(frozen=True)
class MatchParams:
    """``lam == 0`` derives the transition scale from the sample interval."""

    sigma: float = 5.0
    lam: float = 0.0
    radius: float = 100.0
    max_distance: float = 15000.0
    min_bound: float = 1000.0
    bound_speed: int = 33
    window: int = 6
    squared_emission: bool = False
    min_distance: float = 0.0
    min_interval: float = 0.0


@dataclass(frozen=True)
class GridParams:
    """Density grid over the city; cells are numbered 0..cells-1 on each axis."""

    min_lon: float = 115.9913301
    max_lon: float = 117.0029582
    min_lat: float = 39.5430622
    max_lat: float = 40.23978
    cells: int = 100
    capacity: int = 220
    hot: int = 300

    @property
    def lon_step(self) -> float:
        return (self.max_lon - self.min_lon) / self.cells

    @property
    def lat_step(self) -> float:
        return (self.max_lat - self.min_lat) / self.cells
