"""Score model of contests: two Poisson counts from attack, defence, home advantage and covariates, with a dependence between
low scores, fitted to likelihoods whose weights decay with time.

    home rate = exp(attack[home] - defence[away] + gamma + x_home delta),  away rate = exp(attack[away] - defence[home] + x_away delta)

The number of coefficients grows with the sides, so none of them and no matrix of theirs comes to the driver. A pass joins the
strengths to the contests, sums for each side what was scored and what was expected, and moves all attacks (then, in the next
pass, all defences) by the logarithm of their ratio, the exact step of a block. gamma, delta and the dependence rho take a
Newton step on sums of the same pass. Contests of equal sides and covariates are summed beforehand into one cell.

Several decays are fitted in one go: cells, strengths and steps have a column for each, so the number of jobs doesn't depend on
how many there are. Strengths are identified by the attack of the smallest side, which is zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import prob
from tidemark.session import written

LOW = {"t00": (0, 0), "t10": (1, 0), "t01": (0, 1), "t11": (1, 1)}
FLOOR, RHO = -10.0, 0.99


@dataclass
class ScoreModel:
    """strengths: side, and attack0, defence0, attack1, ... for each of ``decays``; shared: gamma, delta and rho by decay."""

    strengths: DataFrame
    decays: tuple[float, ...]
    shared: np.ndarray
    features: tuple[str, ...] = ()
    steps: int = 0
    moved: float = field(default=np.inf)

    def best(self, k: int) -> ScoreModel:
        """The model of one decay alone."""
        only = self.strengths.select("side", F.col(f"attack{k}").alias("attack0"), F.col(f"defence{k}").alias("defence0"))
        return ScoreModel(only, (self.decays[k],), self.shared[k : k + 1], self.features, self.steps, self.moved)

    def rates(self, contests: DataFrame) -> DataFrame:
        """``contests`` (home_id, away_id, covariates) with lh0, la0, lh1, ...; sides never seen have strength zero."""
        return with_rates(contests, self.strengths, self.shared, self.features)


def covariates(features: Sequence[str]) -> list[str]:
    return [f"{side}_{f}" for f in features for side in ("home", "away")]


def cells(contests: DataFrame, decays: Sequence[float], day: str, reference: int, features: Sequence[str] = ()) -> DataFrame:
    """Weighted sums by home, away and covariates: weight, goals and low scores for each decay, the weights one at
    ``reference``. Contests that lack a side, a goal, a day or a covariate are left out."""
    keys = ["home_id", "away_id", *covariates(features)]
    h, a, age = F.col("home_goals"), F.col("away_goals"), F.greatest(F.lit(reference) - F.col(day), F.lit(0))
    sums = []
    for k, xi in enumerate(decays):
        w = F.exp(-float(xi) * age)
        sums += [F.sum(w).alias(f"w{k}"), F.sum(w * h).alias(f"yh{k}"), F.sum(w * a).alias(f"ya{k}")]
        sums += [F.sum(F.when((h == i) & (a == j), w).otherwise(0.0)).alias(f"{t}{k}") for t, (i, j) in LOW.items()]
    return contests.dropna(subset=[*keys, "home_goals", "away_goals", day]).groupBy(*keys).agg(*sums)


def shared_names(n: int, d: int) -> list[str]:
    """Of the coefficients in a row of ``shared``, row by row."""
    return [name for k in range(n) for name in (f"__gamma{k}", *(f"__delta{k}_{i}" for i in range(d)), f"__rho{k}")]


def with_rates(rows: DataFrame, strengths: DataFrame, shared: np.ndarray, features: Sequence[str], carried: bool = False) -> DataFrame:
    """``rows`` with lh0, la0, lh1, ... With ``carried`` the shared coefficients come as columns __gamma0, __delta0_0, __rho0, ...
    of the home side's strengths, and stay: so the plan of one pass is compiled once, not anew for each new number. Expressions
    are text here and below, since their many parts would each be a call to the driver's JVM."""
    n = len(shared)
    values = dict(zip(shared_names(n, len(features)), (repr(float(v)) + "D" for v in shared.ravel()), strict=True))
    for side in ("home", "away"):
        own = [f"{what}{k} AS __{side}_{what}{k}" for what in ("attack", "defence") for k in range(n)]
        more = [f"{v} AS {name}" for name, v in values.items()] if carried and side == "home" else []
        rows = rows.join(strengths.selectExpr(f"side AS {side}_id", *own, *more), f"{side}_id", "left")
    value = {name: name for name in values} if carried else values
    out = []
    for k in range(n):
        for short, own, other in (("lh", "home", "away"), ("la", "away", "home")):
            terms = [f"coalesce(__{own}_attack{k}, 0D)", f"-coalesce(__{other}_defence{k}, 0D)", *([value[f"__gamma{k}"]] if own == "home" else [])]
            terms += [f"{own}_{f} * {value[f'__delta{k}_{i}']}" for i, f in enumerate(features)]
            out.append(f"exp({' + '.join(terms)}) AS {short}{k}")
    return rows.selectExpr(*(f"`{c}`" for c in rows.columns if not c.startswith(("__home_", "__away_"))), *out)


def positive(x: str) -> str:
    return f"greatest({x}, 1e-10D)"


def one_pass(model: ScoreModel, table: DataFrame, block: str) -> tuple[DataFrame, list]:
    """Strengths with the attacks or the defences moved, saved, and the sums that the shared coefficients need."""
    rows = with_rates(table, model.strengths, model.shared, model.features, carried=True)
    n, d = len(model.decays), 1 + len(model.features)
    own, sums = {"home": [], "away": []}, {}
    for k in range(n):
        lh, la, rho, t00, t10, t01, t11 = (f"{c}{k}" for c in ("lh", "la", "__rho", *LOW))
        both = f"t00{k} * lh{k} * la{k} * {rho} / {positive(f'1 - {lh} * {la} * {rho}')}"
        got = {"home": f"(yh{k} - {both} + {t01} * {lh} * {rho} / {positive(f'1 + {lh} * {rho}')})", "away": f"(ya{k} - {both} + {t10} * {la} * {rho} / {positive(f'1 + {la} * {rho}')})"}
        want = {"home": f"(w{k} * {lh})", "away": f"(w{k} * {la})"}
        for side in own:
            own[side] += [f"{got[side]} AS got{k}", f"{want[side]} AS want{k}"]
        x = {side: ["1D" if side == "home" else "0D", *(f"{side}_{f}" for f in model.features)] for side in own}
        sums |= {f"g{k}_{i}": " + ".join(f"({got[s]} - {want[s]}) * {x[s][i]}" for s in x) for i in range(d)}
        sums |= {f"h{k}_{i}_{j}": " + ".join(f"{want[s]} * {x[s][i]} * {x[s][j]}" for s in x) for i in range(d) for j in range(i, d)}
        slopes = {t00: f"-{lh} * {la} / {positive(f'1 - {lh} * {la} * {rho}')}", t10: f"{la} / {positive(f'1 + {la} * {rho}')}", t01: f"{lh} / {positive(f'1 + {lh} * {rho}')}", t11: f"-1D / {positive(f'1 - {rho}')}"}
        sums[f"r{k}"] = " + ".join(f"{t} * ({s})" for t, s in slopes.items())
        sums[f"i{k}"] = " + ".join(f"{t} * ({s}) * ({s})" for t, s in slopes.items())
    # the side whose strength moves: who scored for attacks, who conceded for defences
    of = {"home": "home_id", "away": "away_id"} if block == "attack" else {"home": "away_id", "away": "home_id"}
    part = {s: ", ".join([f"{of[s]} AS side", *own[s], *(f"{e if s == 'home' else '0D'} AS {name}" for name, e in sums.items())]) for s in own}
    parts = rows.selectExpr(f"inline(array(struct({part['home']}), struct({part['away']})))")
    total = parts.groupBy("side").agg(*(F.sum(c).alias(c) for c in parts.columns if c != "side"))
    sign, names = ("" if block == "attack" else "-"), [f"{what}{k}" for k in range(n) for what in ("attack", "defence")]
    new = {f"{block}{k}": f"greatest({FLOOR}D, least({-FLOOR}D, {block}{k} + coalesce({sign}ln(greatest(got{k}, 1e-9D) / {positive(f'want{k}')}), 0D)))" for k in range(n)}
    far = ", ".join(f"abs({e} - {c})" for c, e in new.items())
    moved = model.strengths.join(total, "side", "left").selectExpr("side", *(f"{new.get(c, c)} AS {c}" for c in names), f"greatest(0D, {far}) AS __far", *sums)
    saved = written(moved, "score-strengths")
    return saved.select("side", *names), saved.agg(F.max("__far").alias("far"), *(F.sum(name).alias(name) for name in sums)).first()


def shared_step(shared: np.ndarray, got) -> np.ndarray:
    """Newton steps of gamma and delta, and of rho, from the sums of a pass."""
    out = shared.copy()
    d = shared.shape[1] - 1
    for k in range(len(shared)):
        h = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                h[i, j] = h[j, i] = got[f"h{k}_{i}_{j}"] or 0.0
        g = np.array([got[f"g{k}_{i}"] or 0.0 for i in range(d)])
        out[k, :d] += np.clip(np.linalg.solve(h + 1e-9 * np.eye(d), g), -1, 1)
        out[k, d] = np.clip(out[k, d] + np.clip((got[f"r{k}"] or 0.0) / ((got[f"i{k}"] or 0.0) + 1e-9), -0.1, 0.1), -RHO, RHO)
    return out


def fit(contests: DataFrame, decays: Sequence[float] = (0.0,), day: str = "day", features: Sequence[str] = (), reference: int | None = None, steps: int = 40, tolerance: float = 1e-5) -> ScoreModel:
    """The model of ``contests``: home_id, away_id, home_goals, away_goals, ``day`` (a number), home_<f> and away_<f> for each
    feature. Without ``reference`` the last day has weight one."""
    if reference is None:
        reference = contests.agg(F.max(day)).first()[0] or 0
    table = written(cells(contests, decays, day, int(reference), features), "score-cells")
    n = len(decays)
    sides = table.select(F.explode(F.array("home_id", "away_id")).alias("side")).distinct()
    strengths = written(sides.select("side", *(F.lit(0.0).alias(f"{what}{k}") for k in range(n) for what in ("attack", "defence"))), "score-strengths")
    shared = np.zeros((n, len(features) + 2))
    shared[:, 0] = np.log(1.3)
    model = ScoreModel(strengths, tuple(decays), shared, tuple(features))
    for step in range(steps):
        far = 0.0
        for block in ("defence", "attack"):
            model.strengths, got = one_pass(model, table, block)
            new = shared_step(model.shared, got)
            far = max(far, got["far"] or 0.0, float(np.abs(new - model.shared).max()))
            model.shared = new
        model.steps, model.moved = step + 1, far
        if far < tolerance:
            break
    first = model.strengths.orderBy("side").first()
    shift = {f"{what}{k}": F.col(f"{what}{k}") - float(first[f"attack{k}"]) for k in range(n) for what in ("attack", "defence")} if first else {}
    model.strengths = model.strengths.withColumns(shift)
    return model


def log_loss(model: ScoreModel, contests: DataFrame) -> list[float]:
    """Mean of -log P(score) over ``contests``, for each decay."""
    h, a = F.col("home_goals"), F.col("away_goals")
    rows = model.rates(contests.dropna(subset=["home_goals", "away_goals", *covariates(model.features)]))
    losses = []
    for k in range(len(model.decays)):
        lh, la, rho = F.col(f"lh{k}"), F.col(f"la{k}"), float(model.shared[k, -1])
        tau = F.when((h == 0) & (a == 0), 1 - lh * la * rho).when((h == 1) & (a == 0), 1 + la * rho).when((h == 0) & (a == 1), 1 + lh * rho).when((h == 1) & (a == 1), F.lit(1 - rho)).otherwise(1.0)
        each = F.log(F.greatest(tau, F.lit(1e-10))) + h * F.log(lh) - lh - F.log(F.factorial(h.cast("int")).cast("double")) + a * F.log(la) - la - F.log(F.factorial(a.cast("int")).cast("double"))
        losses.append(F.avg(-each).alias(f"loss{k}"))
    return [float(v) if v is not None else float("nan") for v in rows.agg(*losses).first()]


def decay_search(contests: DataFrame, grid: Sequence[float], cutoff: int, day: str = "day", features: Sequence[str] = (), steps: int = 40, tolerance: float = 1e-5) -> tuple[list[tuple[float, float]], int, ScoreModel]:
    """(decay, loss) for each of ``grid``, fitted before day ``cutoff`` and judged from it on; the index of the least loss (the
    first of equal ones) and the fitted models. One fit and one pass for the whole grid."""
    model = fit(contests.filter(F.col(day) < cutoff), grid, day, features, steps=steps, tolerance=tolerance)
    losses = log_loss(model, contests.filter(F.col(day) >= cutoff))
    return list(zip(map(float, grid), losses, strict=True)), int(np.nanargmin(losses)) if not np.isnan(losses).all() else 0, model


def with_history(fixtures: DataFrame, played: DataFrame, day: str = "day") -> DataFrame:
    """``fixtures`` with home_games and away_games: contests that each side played before the fixture's day."""
    seen = played.select(F.explode(F.array("home_id", "away_id")).alias("side"), F.col(day).alias("__day")).groupBy("side", "__day").agg(F.count("*").alias("__n"))
    # games by day in one order with the fixtures, whose rows come before the games of their own day
    upto = W.partitionBy("side").orderBy("__day", "__order").rowsBetween(W.unboundedPreceding, -1)
    for who in ("home", "away"):
        asked = fixtures.select(F.col(f"{who}_id").alias("side"), F.col(day).alias("__day"), F.lit(0).cast("long").alias("__n"), F.lit(0).alias("__order"), "match_id")
        both = seen.select("side", "__day", "__n", F.lit(1).alias("__order"), F.lit(None).cast(fixtures.schema["match_id"].dataType).alias("match_id")).unionByName(asked)
        counts = both.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).filter("__order = 0").select("match_id", F.col("__before").alias(f"{who}_games"))
        fixtures = fixtures.join(counts, "match_id", "left")
    return fixtures


def exact_scores(model: ScoreModel, fixtures: DataFrame, played: DataFrame, least: int = 5, size: int = 11, day: str = "day") -> DataFrame:
    """Of every fixture (match_id, home_id, away_id, ``day``): rates, the distribution ``joint`` of its score (``size`` x
    ``size``, the last for more), the likeliest score and the three outcomes; all null, with the reason, where a side has
    played fewer than ``least`` contests before or isn't in the model."""
    known = model.strengths.select("side", F.lit(True).alias("__known"))
    rows = with_history(fixtures, played, day)
    for who in ("home", "away"):
        rows = rows.join(known.select(F.col("side").alias(f"{who}_id"), F.col("__known").alias(f"__{who}_known")), f"{who}_id", "left")
    short = [F.when(F.col(f"__{who}_known").isNull() | (F.coalesce(F.col(f"{who}_games"), F.lit(0)) < least), F.lit(f"{who} side lacks history")) for who in ("home", "away")]
    rows = model.rates(rows.withColumn("refused", F.coalesce(*short)).drop("__home_known", "__away_known"))
    ok, rho = F.col("refused").isNull(), float(model.shared[0, -1])
    lh, la = F.when(ok, F.col("lh0")), F.when(ok, F.col("la0"))
    rows = rows.withColumns({"home_rate": lh, "away_rate": la}).drop("lh0", "la0")
    return rows.withColumn("joint", F.when(ok, prob.corrected_joint(F.col("home_rate"), F.col("away_rate"), F.lit(rho), size)))
