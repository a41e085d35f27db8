"""Parameters of the pipeline and of inference."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


# Limits and thresholds of the methods.
@dataclass(frozen=True)
class Params:
    """All numbers that the operators take; ratios in thousandths are called ints."""

    window_size: int = 500
    max_fragment: int = 1000
    min_mapq: int = 30
    max_coverage: float = 2000.0
    smooth_half: int = 2
    ratio_scale: int = 1000
    snp_min_depth: int = 10
    snp_max_depth: int = 1000
    min_segment_snps: int = 10
    min_peak_snps: int = 5
    stddev_divider: float = 20.0
    max_ratio_int: int = 3000
    max_ratio_range_int: int = 100_000
    max_lag: int = 1000
    top_terms: int = 500
    max_period: int = 600
    min_period_run: int = 3
    period_threshold: float = 5.0
    period_ratio: float = 10.0
    first_peak_min: int = 10
    first_peak_max: int = 1050
    peak_height_min: float = 100.0
    half_width_share: float = 0.135
    bound_share: float = 0.606
    shoulder_left: float = 0.8
    shoulder_right: float = 0.9
    shoulder_reach: int = 200
    min_bound_reach: int = 5
    peaks_for_logl: int = 3
    kde_scale: float = 0.3989
    force_period: int = 0
    segment_min_length: int = 50
    segment_threshold: float = 30.0
    segment_a: float = 0.5
    segment_b: float = 1e-20
    segment_tolerance: float = 1e-8
    segment_rounds: int = 50_000
    segment_max_alpha: float = 1e8
    trim_percent: float = 40.0
    bin_width: int = 100_000
    # these stand in outputs only
    snp_maf_stddev_divider: float = 20.0
    snp_coverage_min: int = 2
    snp_coverage_var_ratio: float = 10.0


@dataclass(frozen=True)
class Config:
    """The six positional rows of a configuration file."""

    read_length: int
    window_size: int
    reference_folder: str
    samtools: str
    caller: str
    binary_folder: str

    @staticmethod
    def read(path: str) -> Config:
        """Rows are key, tab, value; keys aren't looked at, the order counts."""
        values = [line.split("\t")[1].strip() for line in Path(path).read_text().splitlines() if line.strip()]
        if len(values) < 6:
            raise ValueError(f"{path} needs six rows, it has {len(values)}")
        return Config(int(values[0]), int(values[1]), *values[2:6])
