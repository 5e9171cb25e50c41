"""Names and constants of a panel: which column plays which role."""

from __future__ import annotations

from dataclasses import dataclass, field

# Band thresholds, band labels, seed and test share.
LOW_MAX = 17.0
MEDIUM_MAX = 38.0
LABELS = ("Low", "Medium", "High")
SEED = 49
TEST_SHARE = 0.25
BOOTSTRAP_DRAWS = 2000


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a subject-day table."""

    subject: str = "subject_id"
    day: str = "day"
    target: str = "score"
    label: str = "label"
    secondary: str = "secondary"
    device_score: str = "device_score"
    device_flag: str = "device_flag"
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    thresholds: tuple[float, float] = (LOW_MAX, MEDIUM_MAX)

    @property
    def key(self) -> list[str]:
        return [self.subject, self.day]

    @property
    def features(self) -> list[str]:
        return [name for names in self.groups.values() for name in names]

    @property
    def forbidden_inputs(self) -> list[str]:
        """Columns a model may never be given."""
        return [
            self.subject,
            self.day,
            self.target,
            self.label,
            self.secondary,
            self.device_score,
            self.device_flag,
        ]

    @property
    def columns(self) -> list[str]:
        return [
            self.subject,
            self.day,
            self.target,
            self.label,
            self.secondary,
            *self.features,
            self.device_score,
            self.device_flag,
        ]


# Feature columns by group.
FEATURE_GROUPS = {
    "sleep": ("sleep_score", "deep_sleep_minutes"),
    "activity": (
        "total_steps",
        "sedentary_minutes",
        "lightly_active_minutes",
        "moderately_active_minutes",
        "very_active_minutes",
    ),
    "hrv": ("avg_rmssd", "avg_low_frequency", "avg_high_frequency"),
    "spo2": ("avg_oxygen", "std_oxygen"),
}

WEARABLE = PanelSpec(
    subject="student_id",
    day="date",
    target="stress",
    label="stress_label",
    secondary="anxiety",
    device_score="STRESS_SCORE",
    device_flag="CALCULATION_FAILED",
    groups=FEATURE_GROUPS,
)

EVENTS = PanelSpec(groups=FEATURE_GROUPS)


def ablation_groups(spec: PanelSpec) -> dict[str, list[str]]:
    """The four feature groups that are compared with one another."""
    g = spec.groups
    return {
        "sleep_only": list(g["sleep"]),
        "activity_only": list(g["activity"]),
        "hrv_spo2_only": [*g["hrv"], *g["spo2"]],
        "all_wearable": spec.features,
    }


def temporal_conditions(spec: PanelSpec) -> dict[str, list[str]]:
    """The five feature sets of the temporal comparison."""
    base = spec.features
    return {
        "no_temporal": base,
        "semester_week_only": [*base, "semester_week"],
        "lag1_wearable": [*base, *(f"{f}_lag1" for f in base)],
        "rolling3_wearable": [*base, *(f"{f}_rolling3_mean" for f in base)],
        "rolling7_wearable": [*base, *(f"{f}_rolling7_mean" for f in base)],
    }


def cumulative_conditions(
    spec: PanelSpec, sources: tuple[str, ...] = ("sleep_score", "total_steps", "avg_rmssd")
) -> dict[str, list[str]]:
    """The older temporal comparison, where each set contains the one before."""
    sets = {"no_temporal": spec.features}
    steps = {
        "semester_week": ["semester_week"],
        "calendar": ["day_of_week", "is_weekend"],
        "lag_1": [f"{f}_lag1" for f in sources],
        "rolling_3": [f"{f}_rolling3_mean" for f in sources],
        "rolling_7": [f"{f}_rolling7_mean" for f in sources],
    }
    last = spec.features
    for name, added in steps.items():
        last = [*last, *added]
        sets[name] = last
    return sets


def deviation_conditions(spec: PanelSpec) -> dict[str, list[str]]:
    base = spec.features
    return {
        "no_temporal": base,
        "deviation_only": [*base, *(f"{f}_deviation_from_past_mean" for f in base)],
    }
