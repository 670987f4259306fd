"""Parameters of the operators."""

from dataclasses import dataclass

FLAG_EDGE = 0x01
FLAG_SATURATED = 0x04  # reserved: no operator sets it


@dataclass(frozen=True)
class BackgroundConfig:
    mesh: int = 64
    kappa: float = 3.0
    max_iter: int = 10


@dataclass(frozen=True)
class DetectConfig:
    sigma: float = 1.6
    thresh: float = 1.5
    minarea: int = 5
    truncate: float = 3.0


@dataclass(frozen=True)
class MeasureConfig:
    kron_factor: float = 2.5
    kron_min_radius: float = 3.5


@dataclass(frozen=True)
class DedupConfig:
    tolerance_arcsec: float = 1.0
    same_brick: bool = False
    min_cos_dec: float = 0.01

