"""Search over the estimator's parameters: random, or led by the densities of good and bad trials (a tree of Parzen estimators)."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import metrics
from .estimator import GraphClustering, GraphModel

#: The default search space.
SPACE = {
    "hidden_dim": {"type": "categorical", "choices": [32, 64, 128]},
    "proj_dim": {"type": "categorical", "choices": [16, 32, 64]},
    "num_layers": {"type": "int", "low": 1, "high": 3},
    "k_neighbors": {"type": "int", "low": 5, "high": 30},
    "temperature": {"type": "float", "low": 0.1, "high": 1.0, "log": True},
    "lr": {"type": "float", "low": 1e-4, "high": 1e-2, "log": True},
}
QUICK_SPACE = {
    "hidden_dim": {"type": "categorical", "choices": [32, 64]},
    "k_neighbors": {"type": "int", "low": 10, "high": 20},
    "temperature": {"type": "float", "low": 0.3, "high": 0.7},
}
METRICS = ("silhouette", "calinski", "davies", "ari", "nmi")
#: Random trials before densities lead; values drawn for a choice; the share of good trials, and the most of them.
STARTUP, DRAWS, GOOD, MOST_GOOD = 10, 24, 0.15, 25


def sample(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, s in space.items():
        if s["type"] == "categorical":
            out[name] = rng.choice(s["choices"])
        elif s["type"] == "int":
            out[name] = rng.randint(s["low"], s["high"])
        elif s.get("log"):
            out[name] = math.exp(rng.uniform(math.log(s["low"]), math.log(s["high"])))
        else:
            out[name] = rng.uniform(s["low"], s["high"])
    return out


class _Numbers:
    """A density over a numeric parameter, scaled to 0..1: a truncated normal around each value, as wide as the greater gap beside it, and a uniform one."""

    def __init__(self, s: dict, values: list[float]):
        self.whole, self.log = s["type"] == "int", s.get("log", False)
        low, high = (s["low"] - 0.5, s["high"] + 0.5) if self.whole else (s["low"], s["high"])
        self.low, self.high, self.limits = *((math.log(low), math.log(high)) if self.log else (low, high)), (s["low"], s["high"])
        self.at = sorted(self.scaled(x) for x in values)
        ends = [0.0, *self.at, 1.0]
        self.width = [min(1.0, max(b - a, c - b, 1 / min(100, len(values) + 2))) for a, b, c in zip(ends, ends[1:], ends[2:], strict=False)]

    def scaled(self, x: float) -> float:
        return ((math.log(x) if self.log else x) - self.low) / ((self.high - self.low) or 1.0)

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.at) + 1)
        u = rng.random()
        if i < len(self.at):
            u = rng.gauss(self.at[i], self.width[i])
            while not 0 <= u <= 1:
                u = rng.gauss(self.at[i], self.width[i])
        x = self.low + u * (self.high - self.low)
        x = math.exp(x) if self.log else x
        x = round(x) if self.whole else x
        return min(max(x, self.limits[0]), self.limits[1])

    def __call__(self, x: float) -> float:
        u, total = self.scaled(x), 1.0
        for m, w in zip(self.at, self.width, strict=True):
            inside = (math.erf((1 - m) / (w * math.sqrt(2))) + math.erf(m / (w * math.sqrt(2)))) / 2
            total += math.exp(-((u - m) ** 2) / (2 * w * w)) / (w * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.at) + 1)


class _Choices:
    """Shares of the choices, each counted once more than it was seen."""

    def __init__(self, s: dict, values: list):
        self.choices, self.n = s["choices"], [1 + values.count(c) for c in s["choices"]]

    def draw(self, rng: random.Random):
        return rng.choices(self.choices, self.n)[0]

    def __call__(self, x) -> float:
        return self.n[self.choices.index(x)] / sum(self.n)


def suggest(space: dict, done: list[tuple[dict, float]], rng: random.Random) -> dict:
    """Parameters whose values are likelier among the good trials than among the others; random ones at first. done: (params, value), higher is better."""
    if len(done) < STARTUP:
        return sample(space, rng)
    ordered = sorted(done, key=lambda t: -t[1])
    n_good = min(MOST_GOOD, max(2, math.ceil(GOOD * len(ordered))))
    out = {}
    for name, s in space.items():
        kind = _Choices if s["type"] == "categorical" else _Numbers
        good, bad = (kind(s, [p[name] for p, _ in part]) for part in (ordered[:n_good], ordered[n_good:]))
        out[name] = max((good.draw(rng) for _ in range(DRAWS)), key=lambda x: good(x) / bad(x))
    return out


@dataclass
class Tuner:
    n_trials: int = 100
    metric: str = "silhouette"
    n_jobs: int = 1
    seed: int = 42
    space: dict = field(default_factory=lambda: dict(SPACE))
    sampler: str = "tpe"

    def __post_init__(self):
        if self.sampler not in ("tpe", "random"):
            raise ValueError("sampler is tpe or random")
        if self.metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")

    def measure(self, model: GraphModel, estimator: GraphClustering, emb: DataFrame, truth: DataFrame | None, label: str) -> float:
        """Higher is better; fewer than two clusters is minus infinity."""
        hidden = cut(model.embeddings(emb, estimator.graph(emb)))
        found = cut(model.predict(hidden).select("cell_id", F.col("label").alias("found")))
        if found.agg(F.count_distinct("found")).first()[0] < 2:
            return -math.inf
        if self.metric in ("ari", "nmi"):
            return metrics.contingency_metrics(found.join(truth, "cell_id"), label, "found").first()[self.metric]
        if self.metric == "silhouette":
            return metrics.silhouette(hidden, found, "found").agg(F.avg("s")).first()[0]
        row = metrics.calinski_davies(hidden, found, "found").first()
        return row["calinski_harabasz"] if self.metric == "calinski" else -row["davies_bouldin"]

    def tune(self, emb: DataFrame, truth: DataFrame | None = None, label: str = "label", run: Callable[[dict], float] | None = None, **fixed) -> DataFrame:
        """trial, params (as text), value, error, ordered from the best; a trial that fails is minus infinity, with what it raised.

        n_jobs trials run at a time; those of one time are drawn from the same trials before them.
        """
        rng = random.Random(self.seed)
        space = {name: s for name, s in self.space.items() if name not in fixed}

        def one(params: dict) -> tuple[float, str | None]:
            try:
                if run is not None:
                    return float(run(params)), None
                estimator = GraphClustering(seed=self.seed, **params)
                return float(self.measure(estimator.fit(emb), estimator, emb, truth, label)), None
            except (ValueError, ArithmeticError) as e:
                return -math.inf, f"{type(e).__name__}: {e}"

        trials, values = [], []
        with ThreadPoolExecutor(self.n_jobs) as pool:
            while len(trials) < self.n_trials:
                done = [(p, v) for p, (v, _) in zip(trials, values, strict=True)] if self.sampler == "tpe" else []
                new = [suggest(space, done, rng) | fixed for _ in range(min(self.n_jobs, self.n_trials - len(trials)))]
                values += pool.map(one, new)
                trials += new
        rows = [(i, repr(p), v, error) for i, (p, (v, error)) in enumerate(zip(trials, values, strict=True))]
        self.best = trials[max(range(len(rows)), key=lambda i: (rows[i][2], -i))]
        return emb.sparkSession.createDataFrame(rows, "trial int, params string, value double, error string").orderBy(F.desc("value"), "trial")

    def best_model(self, emb: DataFrame, **fixed) -> GraphModel:
        return GraphClustering(**{"seed": self.seed} | self.best | fixed).fit(emb)


def auto_tune(emb: DataFrame, truth: DataFrame | None = None, n_trials: int = 50, metric: str = "silhouette", **fixed) -> DataFrame:
    return Tuner(n_trials=n_trials, metric=metric).tune(emb, truth, **fixed)


def quick_tune(emb: DataFrame, n_trials: int = 20, **fixed) -> DataFrame:
    return Tuner(n_trials=n_trials, space=dict(QUICK_SPACE)).tune(emb, **fixed)
