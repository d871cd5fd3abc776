"""Settings of masks, retrieval and speckle filter, with the thresholds the workflow is tuned to."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Radii:
    export_m: float = 15_000.0
    local_m: float = 5_000.0
    plume_m: float = 1_000.0


@dataclass(frozen=True)
class Cloud:
    scene_pct: float = 50.0
    cs_least: float = 0.65
    probability_below: float = 65.0


@dataclass(frozen=True)
class Glint:
    scene_low: float = 0.0
    scene_high: float = 40.0
    local_high: float = 30.0
    index_low: float = -0.30


@dataclass(frozen=True)
class MaskParams:
    radii: Radii = field(default_factory=Radii)
    cloud: Cloud = field(default_factory=Cloud)
    glint: Glint = field(default_factory=Glint)
    saturation: float = 10_000.0
    ndwi_low: float = 0.0
    wind_high: float = 9.0
    outlier: tuple[float, float] = (0.02, 1.0)
    least_kept: float = 0.4


@dataclass(frozen=True)
class Speckle:
    radius_px: int = 10
    sigma0: float = 0.02
    k: float = 300.0


@dataclass(frozen=True)
class PlumeThresholds:
    p1: float = -0.02
    p2: float = -0.04
    p3: float = -0.08
