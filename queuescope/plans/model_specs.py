"""Models to train: estimator family, parameters to search and the treatment of the data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from queuescope.plans.prep import SEED


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from low up to, but not including, high."""

    low: int
    high: int

    def draw(self, random) -> int:
        return random.randrange(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, random) -> float:
        return random.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, random) -> float:
        return self.low * (self.high / self.low) ** random.random()


@dataclass(frozen=True)
class ModelSpec:
    family: str  # "rf", "xgb" or "mlp"
    grid: Mapping[str, object]
    task: str = "regression"
    search: str = "random"
    draws: int = 10
    scaling: str = "none"
    log_policy: str = "none"
    weights: str = "none"
    folds: int = 5
    fold_strategy: str = "kfold"
    lower: float = 0
    upper: float = 10_000_000
    permutation_importance: bool = False
    seed: int = SEED
    fixed: Mapping[str, object] = field(default_factory=dict)

    def but(self, **changes) -> "ModelSpec":
        return replace(self, **changes)


# Search spaces, by the parameter names of the usual Python estimators.
HIDDEN_LAYERS = [(50,), (100,), (50, 50), (100, 100), (200,), (200, 100), (200, 200), (250,), (250, 150), (250, 200), (250, 250)]
FOREST = {
    "n_estimators": IntRange(80, 200),
    "max_depth": [None, *range(5, 30)],
    "min_samples_leaf": IntRange(1, 10),
}
FOREST_CLASSES = {
    "n_estimators": IntRange(80, 200),
    "max_depth": [None, *range(5, 20)],
    "min_samples_leaf": IntRange(1, 10),
    "criterion": ["gini", "entropy", "log_loss"],
    "max_features": ["sqrt", "log2", None, 0.2, 0.5, 1.0],
}
BOOSTED = {
    "n_estimators": IntRange(80, 700),
    "learning_rate": LogUniform(0.01, 0.3),
    "subsample": Uniform(0.5, 1.0),
    "max_depth": IntRange(3, 15),
    "gamma": LogUniform(1e-4, 5.0),
    "min_child_weight": IntRange(1, 10),
    "colsample_bytree": Uniform(0.5, 1.0),
}
BOOSTED_CLASSES = {
    "n_estimators": IntRange(80, 500),
    "learning_rate": LogUniform(1e-3, 3e-1),
    "subsample": Uniform(0.5, 1.0),
    "max_depth": IntRange(3, 30),
    "gamma": LogUniform(1e-5, 1.0),
    "min_child_weight": IntRange(1, 10),
    "colsample_bytree": Uniform(0.5, 1.0),
}
NETWORK_CLASSES = {
    "hidden_layer_sizes": HIDDEN_LAYERS,
    "max_iter": [2000],
    "learning_rate_init": [0.0003, 0.001, 0.01],
}

REGRESSORS = {
    "rf": ModelSpec("rf", FOREST, draws=30, lower=1, log_policy="only_target", weights="aggressive"),
    "xgb": ModelSpec(
        "xgb", BOOSTED, draws=30, lower=1, log_policy="only_target", weights="aggressive", permutation_importance=True
    ),
}
CLASSIFIERS = {
    "rf": ModelSpec("rf", FOREST_CLASSES, "classification", draws=50, upper=11),
    "xgb": ModelSpec("xgb", BOOSTED_CLASSES, "classification", draws=50, upper=11, permutation_importance=True),
    "mlp": ModelSpec(
        "mlp", NETWORK_CLASSES, "classification", draws=30, upper=11, scaling="all_variables", log_policy="all_variables",
        fold_strategy="timeseries", permutation_importance=True,
    ),
}
