"""Thresholds, rates and weights used by the operators.

All numbers below are fixed values: they define the published metrics, so they
are stated plainly. Override any of them by building another ``EngineConfig``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

Bands = tuple[tuple[float, float], ...]

# Price per DBU by cloud and cluster type (standard tier).
STANDARD_RATES: Mapping[str, Mapping[str, float]] = MappingProxyType(
    {
        cloud: MappingProxyType(
            {
                "compute": 0.15,
                "all_purpose": 0.55,
                "jobs": 0.15,
                "sql_compute": 0.22,
                "sql_serverless": 0.70,
            }
        )
        for cloud in ("azure", "aws", "gcp")
    }
)

# Weight of each dimension in the maturity score.
SCORE_WEIGHTS: Mapping[str, float] = MappingProxyType(
    {
        "compute": 0.25,
        "storage": 0.25,
        "governance": 0.20,
        "pipelines": 0.15,
        "observability": 0.10,
        "costs": 0.05,
    }
)


@dataclass(frozen=True)
class EngineConfig:
    # --- storage derivations
    small_file_mb: float = 128.0
    warm_days: int = 30
    cold_days: int = 90
    abandoned_days: int = 180
    cold_savings_share: float = 0.5
    small_files_high_gb: float = 100.0
    cold_medium_gb: float = 10.0
    unpartitioned_medium_gb: float = 50.0

    # --- compute derivations; bands are (upper bound exclusive, score)
    idle_hours: float = 4.0
    overprovisioned_workers: int = 10
    overprovisioned_idle_hours: float = 2.0
    utilization_bands: Bands = ((1.0, 1.0), (4.0, 0.7), (8.0, 0.4))
    utilization_floor: float = 0.1
    utilization_unknown: float = 0.5
    # (lower bound inclusive, score)
    efficiency_bands: Bands = ((0.95, 1.0), (0.80, 0.7), (0.60, 0.4))
    efficiency_floor: float = 0.1
    rank_bucket_hours: float = 1.0

    # --- compute cost
    rates: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: STANDARD_RATES)
    fallback_cloud: str = "azure"
    monthly_hours: float = 30.0
    default_fx_rate: float = 1.0

    # --- pipeline allocation
    charge_mode: str = "full"  # or "prorated": share of the cluster's execution time
    month_factor: float = 30.0
    lookback_days: int = 30
    sla_fast_hours: float = 0.5
    sla_slow_hours: float = 4.0

    # --- scores
    weights: Mapping[str, float] = field(default_factory=lambda: SCORE_WEIGHTS)
    # (upper bound exclusive, score) on the relative cost change
    cost_change_bands: Bands = ((-0.1, 1.0), (0.0, 0.7), (0.1, 0.5))
    cost_change_floor: float = 0.3
    cost_unknown: float = 0.5
    trend_recent_rows: int = 7
    billing_rows: int = 30

    # --- benchmarks: excellent / good / average cut-offs
    bench_cost_per_tb: tuple[float, float, float] = (50.0, 100.0, 200.0)
    bench_utilization: tuple[float, float, float] = (0.8, 0.6, 0.4)
    bench_success: tuple[float, float, float] = (0.98, 0.95, 0.90)
    bench_cold_share: tuple[float, float, float] = (0.10, 0.20, 0.30)
    bench_overall: tuple[float, float, float] = (3.5, 2.5, 1.5)

    # --- reconciliation and confidence
    variance_reconciled_pct: float = 5.0
    variance_close_pct: float = 15.0
    confidence_high: float = 0.9
    confidence_medium: float = 0.7
    confidence_low: float = 0.5
    confidence_floor: float = 0.3
    variance_penalty_cap: float = 0.3
    savings_bonus_above: float = 10000.0
    savings_malus_below: float = 100.0
    savings_step: float = 0.1

    # --- savings
    worker_hour_usd: float = 0.5
    gb_month_usd: float = 0.023
    run_hour_usd: float = 2.0
    failed_run_usd: float = 2.0
    autoscaling_saved: float = 0.4
    resize_factor: float = 0.7
    archive_saved: float = 0.7
    optimize_saved: float = 0.1
    fix_failures_saved: float = 0.8
    long_runs_saved: float = 0.3

    # --- rules and audits
    top_recommendations: int = 10
    failure_rate_high: float = 0.2
    partial_drop: float = 0.25  # least fall of a finding's measure that counts as partly done
    optimize_min_gb: float = 10.0
    autoscaling_min_workers: int = 5
    long_run_hours: float = 4.0
    long_runs_listed: int = 20
    long_runs_days: int = 30
    auto_execute_idle_hours: float = 8.0
    quick_win_cluster_usd: float = 100.0
    quick_win_table_usd: float = 50.0
    quick_wins_listed: int = 10
    critical_issues_listed: int = 10
    error_key_chars: int = 100
    errors_listed: int = 10
    error_high_count: int = 10
    error_medium_count: int = 5
    waste_failure_rate: float = 0.1
    waste_performance_rate: float = 0.3
    waste_high_usd: float = 100.0
    waste_medium_usd: float = 50.0

    def __post_init__(self) -> None:
        if self.charge_mode not in ("full", "prorated"):
            raise ValueError(f"unknown charge_mode: {self.charge_mode}")
        # The rate card becomes literals inside the plan, so it must stay small.
        if sum(len(v) for v in self.rates.values()) > 1000:
            raise ValueError("rate card too large for literals; pass it as a DataFrame")


DEFAULT = EngineConfig()
