"""Default parameters of the sequence pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """One immutable parameter set; every plan takes one instead of module state."""

    sample_seconds: int = 1  # length of one tick of a series
    series: str = "profile"  # "profile" or "offset"
    l_kernel: int = 8
    var_kernel: float = 0.5
    median_len: int = 24
    sigma: float = 2.0
    offset_rel: float = 0.05
    resampling_size: int = 30
    num_searches: int = 10
    dist_threshold: float = 2.0
    sakoe_chiba_radius: int = 5
    itakura_max_slope: float = 3.0
    lcss_eps: float = 1.0
    soft_gamma: float = 1.0
    title_threshold: float = 0.98
    n_regions: tuple[int, ...] = (10, 11, 12, 13, 14)
    fluss_m: int = 3


DEFAULT = Config()


@dataclass(frozen=True)
class Experiment:
    """One cover-retrieval configuration."""

    distance: str
    series: str
    stretch: bool = False
    constraint: str | None = None
    normalize: bool = False
    label: str = field(default="", compare=False)


# The experiment grid of the cover-retrieval task, in its order.
EXPERIMENTS: tuple[Experiment, ...] = (
    Experiment("tpsd", "offset"),
    Experiment("tpsd", "profile"),
    Experiment("dtw", "offset", True),
    Experiment("dtw", "profile", True),
    Experiment("dtw", "offset", False),
    Experiment("dtw", "profile", False),
    Experiment("dtw", "offset", True, "sakoe_chiba"),
    Experiment("dtw", "profile", True, "sakoe_chiba"),
    Experiment("dtw", "offset", True, "itakura"),
    Experiment("dtw", "profile", True, "itakura"),
    Experiment("dtw", "offset", False, "sakoe_chiba"),
    Experiment("dtw", "profile", False, "sakoe_chiba"),
    Experiment("dtw", "offset", True, "sakoe_chiba", True),
    Experiment("dtw", "profile", True, "sakoe_chiba", True),
    Experiment("lcss", "offset", False, "sakoe_chiba"),
    Experiment("lcss", "offset", False, "itakura"),
    Experiment("sdtw", "offset", True),
    Experiment("sdtw", "profile", True),
    Experiment("sdtw", "offset", True, "sakoe_chiba"),
    Experiment("sdtw", "profile", True, "sakoe_chiba"),
    Experiment("sdtw", "offset", False, "sakoe_chiba"),
    Experiment("sdtw", "offset", True, "itakura"),
)
