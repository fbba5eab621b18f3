"""Parameters of the phenology chain, and its fixed tables."""

from __future__ import annotations

from dataclasses import dataclass

# Numbers of the vegetation classes.
VEG_CLASSES = {
    "CRO": 1, "DBF": 2, "MF": 3, "ENF": 4, "CSH": 5, "GRA": 6, "OSH": 7, "SAV": 8, "WSA": 9, "WET": 10, "EBF": 11, "CVM": 12,
}


@dataclass(frozen=True)
class Params:
    """Thresholds of every step; the defaults are the reference product's."""

    years: tuple[int, ...] = (2017, 2018, 2019, 2020, 2021)
    min_seg_amplitude: float = 0.1
    max_increase: int = 185
    max_decrease: int = 185
    rel_amp_frac: float = 0.35
    green_up: tuple[float, ...] = (0.15, 0.5, 0.9)
    green_down: tuple[float, ...] = (0.9, 0.5, 0.15)
    dormant_quantile: float = 0.05
    dormant_from: str = "2017-01-01"
    dormant_to: str = "2021-12-31"
    spike_ratio: float = 2.0
    min_residual: float = 0.1
    max_distance: int = 45
    max_despike_passes: int = 50
    mad_factor: float = 2.0
    mad_center: str = "reference"
    composite_days: int = 0  # 3 for three-day composites, 0 for none
    spline_buffer: int = 185
    spar: float = 0.55
    gap_days: int = 20
    max_weight: float = 0.5
    min_common_days: int = 90
    negative_share: float = 0.5
    water_low: float = 30.0
    water_high: float = 80.0
    dormant_low: float = 0.05
    weak_low: float = 0.2
    weak_high: float = 0.3
    qa_r2: float = 0.75
    qa_gap: int = 20

    @property
    def slots(self) -> int:
        """Days of a year's window."""
        return 365 + 2 * self.spline_buffer


# The 24 layers of a product year (number, name, long name, units, scale, least and largest valid value).
_CYCLE = (
    ("OGI", "Onset of greenness increase", "Day of year", 1.0, -181, 548),
    ("50PCGI", "Half of greenness increase", "Day of year", 1.0, -181, 548),
    ("OGMx", "Onset of greenness maximum", "Day of year", 1.0, -181, 548),
    ("Peak", "Peak of the cycle", "Day of year", 1.0, 1, 366),
    ("OGD", "Onset of greenness decrease", "Day of year", 1.0, -181, 548),
    ("50PCGD", "Half of greenness decrease", "Day of year", 1.0, -181, 548),
    ("OGMn", "Onset of greenness minimum", "Day of year", 1.0, -181, 548),
    ("EVImax", "Maximum of the index in the cycle", "-", 0.0001, 0, 10000),
    ("EVIamp", "Amplitude of the index in the cycle", "-", 0.0001, 0, 10000),
    ("EVIarea", "Sum of the index over the cycle", "-", 0.01, 0, 32766),
    ("QA", "Quality class of the cycle", "-", 1.0, 1, 4),
)
FILL = 32767
LAYERS = [
    (i + 1, *row)
    for i, row in enumerate(
        [("NumCycles", "Number of cycles", "Number", 1.0, 0, 6)]
        + list(_CYCLE)
        + [(f"{short}_2", f"{long}, second cycle", *rest) for short, long, *rest in _CYCLE]
        + [("numObs", "Days with a clear observation", "Number", 1.0, 0, 366)]
    )
]
LAYER_NAMES = [row[1] for row in LAYERS]
