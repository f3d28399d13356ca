"""Run configuration and its driver-side guards."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default run settings and accepted bounds.
POLYGON_VARS = ("admin0", "admin1", "admin2", "ecoregion")
EXACT_VARS = ("admin0", "admin1", "admin2", "ecoregion", "pa")
DUAL_PURPOSE_VARS = ("ecoregion", "pa")
CATEGORICAL_VARS = ("ecoregion", "admin0", "admin1", "admin2")
REQUIRED_SITE_COLUMNS = ("site_id", "site_name", "start_date")
REQUIRED_MATCH_COLUMNS = (
    "cell", "site_id", "id_numeric", "area_ha", "treatment",
    "sampled_fraction", "total_biomass", "match_group", "match_weight",
)
OPEN_END_YEAR = 2099
FIRST_COVER_YEAR = 2000
LAST_COVER_YEAR = 2024
PRE_INTERVENTION_YEARS = 5
PRE_DEFOR_FIRST_START = 2005
DEFAULT_SEED = 20240101
#: Least value of each setting; only the seed has an upper bound, that of a 32-bit integer.
LEAST = {
    "max_treatment_pixels": 1, "control_multiplier": 1, "min_site_area_ha": 0,
    "min_glm_treatment_pixels": 1, "max_controls_per_treatment": 0, "caliper_width": 0,
    "random_seed": 1,
}
LARGEST_SEED = 2_147_483_647


@dataclass(frozen=True)
class MatchConfig:
    """Settings of one run; invalid combinations raise ``ValueError``.

    ``max_controls_per_treatment`` 0 means full matching and ``caliper_width``
    0 switches the caliper off. Runs are always seeded: with no seed given the
    documented ``DEFAULT_SEED`` is used, so reruns give the same sample.

    ``local_rows`` bounds what a single Python task may hold. Strata above it
    take the distributed path; it changes the plan, never the result.
    """

    covariates: tuple[str, ...]
    exact_match_vars: tuple[str, ...] = ("admin0", "admin1", "admin2", "ecoregion", "pa")
    fc_years: tuple[int, ...] = tuple(range(FIRST_COVER_YEAR, LAST_COVER_YEAR + 1))
    task_id: str = "run"
    max_treatment_pixels: int = 1000
    control_multiplier: int = 50
    min_site_area_ha: float = 100
    min_glm_treatment_pixels: int = 15
    caliper_width: float = 0.2
    max_controls_per_treatment: int = 1
    random_seed: int = DEFAULT_SEED
    distance_scale: str = "mad"
    scale_by_area: bool = False
    local_rows: int = 250_000
    ready_covariates: tuple[str, ...] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        for name in ("covariates", "exact_match_vars", "fc_years"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if not self.exact_match_vars:
            raise ValueError("at least one exact match variable is needed")
        overlap = sorted(set(self.covariates) & set(self.exact_match_vars))
        if overlap:
            raise ValueError(f"used both as covariate and as exact match: {overlap}")
        if not self.covariates:
            raise ValueError("at least one covariate is needed")
        if not self.fc_years:
            raise ValueError("at least one forest cover year is needed")
        if self.ready_covariates is not None:
            missing = sorted(set(self.covariates) - set(self.ready_covariates))
            if missing:
                raise ValueError(f"covariates not ready: {missing}")
        for name, least in LEAST.items():
            if not getattr(self, name) >= least:
                raise ValueError(f"{name} must be at least {least}")
        if self.random_seed > LARGEST_SEED:
            raise ValueError(f"random_seed must be at most {LARGEST_SEED}")
        if self.distance_scale not in ("mad", "sd"):
            raise ValueError("distance_scale must be 'mad' or 'sd'")

    @property
    def cover_columns(self) -> list[str]:
        return [f"fc_{year}" for year in sorted(self.fc_years)]

    @property
    def layers(self) -> list[str]:
        """Layers a run reads, in order and without repeats."""
        wanted = [*self.covariates, "total_biomass", *self.exact_match_vars, *self.cover_columns]
        return list(dict.fromkeys(wanted))

    @property
    def extent_vars(self) -> list[str]:
        return [v for v in self.exact_match_vars if v in POLYGON_VARS]


def require_columns(columns, required, what: str) -> None:
    """Raise when any of ``required`` is absent from ``columns``."""
    missing = [c for c in required if c not in set(columns)]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
