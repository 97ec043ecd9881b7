"""Settings that change results, and the walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

# --- Fixed values: they must equal the published ones for the results to match ---
HORIZON = 92
CONFIDENCE_LEVEL = 0.95
ANOMALY_PROBABILITY = 0.95
METRICS = ("mape", "rmse", "mae", "mase", "coverage")
HIGHER_IS_BETTER = ("coverage",)
CPM = 5.5
HIGH_RISK_ANNUAL = 100_000.0
CV_REGRESSOR_MAX = 0.3
CV_EVENT_DRIVEN = 0.5
COLD_START_DAYS = 90
MISSING_PCT_MAX = 20.0
LOW_TRAFFIC = 100
STEP_WINDOW = 30
STEP_RATIO = 2.0
INTERVAL_NARROW_PCT = 20.0
INTERVAL_WIDE_PCT = 100.0
WEEKEND_DIP = 0.10
WEEKEND_DIP_STRONG = 0.15
WEEKLY_SWING = 0.20
YEARLY_SWING = 0.30
YEAR_SHIFT_PCT = 5.0
MARKET_WEEKEND_PCT = -15.0
ROUND_THE_CLOCK_WEEKEND_PCT = -10.0
TREND_PCT = 20.0
BASELINE_SHIFT_PCT = 15.0
RETRAIN_LOOKBACK_DAYS = 730
RETRAIN_MAPE_GATE = 0.20

# --- Our own names and choices ---
ZERO_SHOT = "seasonal_zero_shot"
STRUCTURAL = "structural"
REGRESSOR = "structural_xreg"
MODELS = (ZERO_SHOT, STRUCTURAL, REGRESSOR)
CROSS_FOLD = "cross_fold_avg"
DETAIL_FOLD = "fold_2"


@dataclass(frozen=True)
class Fold:
    """One train/test split; both ranges are inclusive."""

    name: str
    train_start: date
    train_end: date
    test_start: date
    test_end: date

    @classmethod
    def of(cls, name: str, *bounds: str) -> "Fold":
        return cls(name, *(date.fromisoformat(b) for b in bounds))

    @property
    def test_days(self) -> int:
        return (self.test_end - self.test_start).days + 1


def expanding_folds(start: date, first_test: date, count: int, horizon: int = HORIZON) -> list[Fold]:
    """``count`` folds that share a start and test back-to-back windows of ``horizon`` days."""
    folds = []
    for i in range(count):
        test_start = first_test + timedelta(days=i * horizon)
        folds.append(
            Fold(
                f"fold_{i + 1}",
                start,
                test_start - timedelta(days=1),
                test_start,
                test_start + timedelta(days=horizon - 1),
            )
        )
    return folds


# The two published folds.
DEFAULT_FOLDS = [
    Fold.of("fold_1", "2023-01-01", "2024-06-30", "2024-07-01", "2024-09-30"),
    Fold.of("fold_2", "2023-01-01", "2024-09-30", "2024-10-01", "2024-12-31"),
]


def check_horizon(folds: list[Fold], horizon: int = HORIZON) -> bool:
    """Raise unless every test window is exactly ``horizon`` days long."""
    wrong = {f.name: f.test_days for f in folds if f.test_days != horizon}
    if wrong:
        raise ValueError(f"test windows must be {horizon} days long, found {wrong}")
    return True


def resolve_fold(fold: str, detail: str = DETAIL_FOLD) -> str:
    """Per-series views have no cross-fold rows: fall back to one fold."""
    return detail if fold == CROSS_FOLD else fold
