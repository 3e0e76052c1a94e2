"""Elo ratings of contests, a season at a time.

A contest moves both sides by k x margin x (result - expectation), the expectation a logistic of the rating gap with home
advantage; all contests of a day see the ratings that the day began with. Between seasons, sides that played the season
before are drawn towards the mean of their new level by ``regress``; others enter at the mean of the level's three lowest
ratings of that season or, where it has none, at ``base``, less ``gap`` in the second level. A season's contests come before
those of the next one.

Settings to be compared are rated together: a ladder holds a matrix of sides by at most ``SETTINGS`` settings, and the contests are
shuffled once for each so many. They pass a task in order, a few days at a time, so it holds a ladder's sides but not its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rating rule; ``margin`` says whether wide wins count for more.
ELO = {"k": 15.0, "home": 40.0, "regress": 0.0, "gap": 100.0, "base": 1500.0, "scale": 400.0, "lowest": 3, "margin": True}
RATINGS = ["match_id", "home_elo", "away_elo", "home_played", "away_played"]
#: Contests that are rated in one go at most, but for a day of more; ratings of a side in one go; settings of a task.
STEP_ROWS = 200_000
CELLS = 1 << 22
SETTINGS = 96


class Ladder:
    """Ratings (sides x settings), games, last season and level of a ladder's sides; the open season, and by level the mean
    rating and that of the lowest ones of the season before."""

    def __init__(self, settings: Sequence[dict]):
        full = [ELO | s for s in settings]
        self.p = {k: np.array([s[k] for s in full], float) for k in ELO}
        self.at: dict = {}
        self.rating, self.games, self.season, self.level = np.empty((0, len(full))), np.empty(0), np.empty(0), np.empty(0)
        self.opened: float = np.nan
        self.levels: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def held(self) -> dict:
        """All of it as plain lists, for a state or a file."""
        arrays = {k: getattr(self, k).tolist() for k in ("rating", "games", "season", "level")}
        return arrays | {"sides": list(self.at), "opened": None if np.isnan(self.opened) else self.opened, "levels": [[k, m.tolist(), x.tolist()] for k, (m, x) in self.levels.items()]}

    @classmethod
    def of(cls, held: dict | None, settings: Sequence[dict]) -> Ladder:
        out = cls(settings)
        if held:
            out.at = {s: i for i, s in enumerate(held["sides"])}
            out.rating = np.array(held["rating"], float).reshape(len(out.at), len(settings))
            out.games, out.season, out.level = (np.array(held[k], float) for k in ("games", "season", "level"))
            out.opened = np.nan if held["opened"] is None else held["opened"]
            out.levels = {k: (np.array(m), np.array(x)) for k, m, x in held["levels"]}
        return out

    def open(self, season: float) -> None:
        if self.opened >= season:
            return
        self.opened, self.levels = season, {}
        last = self.season == season - 1
        for level in np.unique(self.level[last & ~np.isnan(self.level)]):
            ratings = self.rating[last & (self.level == level)]
            few = min(int(self.p["lowest"][0]), len(ratings))
            self.levels[float(level)] = (ratings.mean(axis=0), np.sort(np.partition(ratings, few - 1, axis=0)[:few], axis=0).mean(axis=0))

    def enter(self, sides: np.ndarray, levels: np.ndarray, season: float) -> None:
        """``sides`` (their first appearance in the season and its level) at the ratings that they begin it with."""
        new = [s for s in sides.tolist() if s not in self.at]
        if new:
            self.at |= {s: len(self.at) + i for i, s in enumerate(new)}
            self.rating = np.concatenate([self.rating, np.full((len(new), self.rating.shape[1]), np.nan)])
            self.games, self.season, self.level = (np.concatenate([x, np.full(len(new), v)]) for x, v in ((self.games, 0.0), (self.season, np.nan), (self.level, np.nan)))
        at = np.fromiter((self.at[s] for s in sides.tolist()), np.int64, len(sides))
        fresh = ~(self.season[at] >= season)
        at, levels = at[fresh], levels[fresh]
        stays = self.season[at] == season - 1
        for level in np.unique(levels):  # those without a level are one
            mine = np.isnan(levels) if np.isnan(level) else levels == level
            mean, low = self.levels.get(float(level), (None, self.p["base"] - (self.p["gap"] if level == 2 else 0.0)))
            if mean is not None:
                old = at[mine & stays]
                self.rating[old] = mean + (1 - self.p["regress"]) * (self.rating[old] - mean)
            self.rating[at[mine & ~stays]] = low
        self.season[at], self.level[at] = season, levels

    def add(self, at: np.ndarray, moved: np.ndarray) -> None:
        """``moved`` to the ratings ``at``, one after the other where a side is there twice; np.add.at is slow for all."""
        once = np.zeros(len(at), bool)
        once[np.unique(at, return_index=True)[1]] = True
        if once.all():
            self.rating[at] += moved
        else:
            self.rating[at[once]] += moved[once]
            np.add.at(self.rating, at[~once], moved[~once])

    def contest(self, rows: pd.DataFrame, day: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ratings (rows x settings) and games of home and away before each of ``rows``, one season sorted by day."""
        home, away = (np.fromiter((self.at[s] for s in rows[c].tolist()), np.int64, len(rows)) for c in ("home_id", "away_id"))
        margin = (rows["home_goals"].astype(float) - rows["away_goals"].astype(float)).to_numpy()
        counts = rows["played"].fillna(False).to_numpy(bool) & ~np.isnan(margin)
        wide = np.abs(np.where(counts, margin, 0))
        factor = np.where(wide <= 1, 1.0, np.where(wide == 2, 1.5, (11 + wide) / 8))
        factor = np.where(self.p["margin"] > 0, factor[:, None], 1.0) * self.p["k"] * counts[:, None]
        result = (np.sign(np.where(counts, margin, 0)) + 1) / 2
        before = [np.empty((len(rows), self.rating.shape[1])) for _ in range(2)] + [np.empty(len(rows)) for _ in range(2)]
        edges, slope = np.flatnonzero(np.diff(rows[day].to_numpy())) + 1, -np.log(10) / self.p["scale"]
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(rows)], strict=True):
            h, w = home[a:b], away[a:b]
            rh, rw = self.rating[h], self.rating[w]
            before[0][a:b], before[1][a:b], before[2][a:b], before[3][a:b] = rh, rw, self.games[h], self.games[w]
            moved = factor[a:b] * (result[a:b, None] - 1 / (1 + np.exp((rh + self.p["home"] - rw) * slope)))
            self.add(h, moved)
            self.add(w, -moved)
            np.add.at(self.games, h, counts[a:b])
            np.add.at(self.games, w, counts[a:b])
        return tuple(before)

    def play(self, rows: pd.DataFrame, day: str = "day") -> tuple[pd.DataFrame, tuple[np.ndarray, ...]]:
        """``rows`` in order, and ratings and games before each. ``rows`` may have ``regular``: contests that don't say which
        level their sides belong to."""
        rows = rows.sort_values(["season", day, "match_id"], kind="stable").reset_index(drop=True)
        parts = []
        for season, part in rows.groupby("season", sort=True):
            self.open(float(season))
            both = part[["home_id", "away_id"]].to_numpy().ravel()
            level = np.repeat(part["level"].to_numpy(float), 2)
            _, first = np.unique(both, return_index=True)
            self.enter(both[np.sort(first)], level[np.sort(first)], float(season))
            parts.append(self.contest(part.reset_index(drop=True), day))
            told = np.repeat(part["regular"].to_numpy(bool), 2) if "regular" in part else np.ones(len(both), bool)
            self.level[np.fromiter((self.at[s] for s in both[told].tolist()), np.int64, told.sum())] = level[told]  # the last one stays
        n = self.rating.shape[1]
        empty = (np.empty((0, n)), np.empty((0, n)), np.empty(0), np.empty(0))
        return rows, tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty


def start() -> dict:
    """What a ladder holds before its first contest."""
    return Ladder([{}]).held()


def rate(rows: pd.DataFrame, held: dict, day: str = "day", params: dict | None = None) -> tuple[pd.DataFrame, dict]:
    """Ratings before each contest of one ladder, and what it holds then."""
    ladder = Ladder.of(held, [params or {}])
    ordered, before = ladder.play(rows, day)
    return rated(ordered, before), ladder.held()


def rated(rows: pd.DataFrame, before: tuple[np.ndarray, ...]) -> pd.DataFrame:
    return pd.DataFrame({"match_id": rows["match_id"].to_numpy(), "home_elo": before[0][:, 0], "away_elo": before[1][:, 0], "home_played": before[2].astype(int), "away_played": before[3].astype(int)})


def played_through(batches: Iterable[pd.DataFrame], day: str, settings: Sequence[dict], told: Callable[[pd.DataFrame, tuple[np.ndarray, ...], int], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> Iterator[pd.DataFrame]:
    """What ``told`` says of contests that come by ladder, first setting (``__first``), season and day, as they pass: whole days of at
    most ``STEP_ROWS`` contests and ``CELLS`` ratings a side, one day at least. With ``merge`` a ladder's answers are merged into one."""
    mine, ladder, rest, said = None, None, None, []
    most = max(1, min(STEP_ROWS, CELLS // min(len(settings), SETTINGS)))

    def play(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal said
        codes = rows[["season", day]].ne(rows[["season", day]].shift()).any(axis=1).cumsum().to_numpy()  # of days
        start = 0
        while start < len(rows):
            stop = start + most
            if stop < len(rows):
                stop = int(np.searchsorted(codes, codes[stop], "left"))
            if stop <= start:
                stop = int(np.searchsorted(codes, codes[start], "right"))
            ordered, got = mine.play(rows.iloc[start : min(stop, len(rows))], day)
            one = told(ordered, got, ladder[1])
            if merge:
                said = [merge(pd.concat([*said, one]))]
            else:
                yield one
            start = stop

    for batch in whole_batches(batches, most):
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        rest = None
        for key, rows in batch.groupby(["__ladder", "__first"], sort=False, dropna=False):
            key = (key[0] if isinstance(key[0], str) else None, int(key[1]))
            if key != ladder:
                if rest is not None:
                    yield from play(rest)
                yield from said
                ladder, mine, said = key, Ladder(settings[key[1] : key[1] + SETTINGS]), []
            last = rows.iloc[-1]
            open_ = (rows["season"] == last["season"]) & (rows[day] == last[day])  # the day may go on in the next batch
            if (~open_).any():
                yield from play(rows[~open_])
            rest = rows[open_]
    if rest is not None:
        yield from play(rest)
    yield from said


def whole_batches(batches: Iterable[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``least`` rows."""
    some, n = [], 0
    for batch in batches:
        some, n = [*some, batch], n + len(batch)
        if n >= least:
            yield pd.concat(some, ignore_index=True)
            some, n = [], 0
    if n:
        yield pd.concat(some, ignore_index=True)


def folded(contests: DataFrame, ladder: str, day: str, settings: Sequence[dict], told: Callable[[pd.DataFrame, tuple[np.ndarray, ...], int], pd.DataFrame], schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """What ``told`` says (columns of ``schema``) of each ladder's contests, in order, of ratings and games before them and of the
    first of the settings that these are of."""
    columns = [c.strip().split()[0] for c in schema.split(",")]
    complete = contests.dropna(subset=["home_id", "away_id", "season", day]).withColumn("__ladder", F.col(ladder).cast("string"))
    used = {"match_id", "season", "level", day, "home_id", "away_id", "home_goals", "away_goals", "played", "regular"} & set(contests.columns)
    firsts = F.explode(F.array(*(F.lit(i) for i in range(0, len(settings), SETTINGS))))
    keyed = complete.select("__ladder", *sorted(used), firsts.alias("__first"))
    parts = max(int(contests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(settings) // SETTINGS))
    dealt = keyed.repartition(parts, "__ladder", "__first").sortWithinPartitions("__ladder", "__first", "season", day, "match_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in played_through(batches, day, settings, told, merge):
            yield out[columns]

    return dealt.mapInPandas(run, schema)


def elo(contests: DataFrame, ladder: str, day: str = "day", params: dict | None = None) -> DataFrame:
    """Ratings before each contest. contests: match_id, ladder, season, level, day, home_id, away_id, home_goals, away_goals,
    played. Contests without a season, a day or a side are left out."""
    kind = contests.schema["match_id"].dataType.simpleString()
    return folded(contests, ladder, day, [params or {}], lambda rows, before, _: rated(rows, before), f"match_id {kind}, home_elo double, away_elo double, home_played int, away_played int")


def gap_counts(contests: DataFrame, ladder: str, grid: Sequence[dict], first_season: int, day: str = "day", width: float = 5.0) -> DataFrame:
    """setting, gap, outcome (0 away, 1 draw, 2 home), n: contests played from ``first_season`` on, counted by rating gap in
    steps of ``width`` for each setting. Counts of a ladder are made where it is rated, so ratings are never written."""

    def told(rows: pd.DataFrame, before: tuple[np.ndarray, ...], first: int) -> pd.DataFrame:
        margin = (rows["home_goals"].astype(float) - rows["away_goals"].astype(float)).to_numpy()
        counts = rows["played"].fillna(False).to_numpy(bool) & ~np.isnan(margin) & (rows["season"].to_numpy() >= first_season)
        gap = np.floor((before[0] - before[1])[counts] / width).astype(np.int64)
        outcome = (np.sign(margin[counts]) + 1).astype(np.int64)
        parts = []
        for k in range(gap.shape[1] if len(gap) else 0):
            low = int(gap[:, k].min())
            n = np.bincount((gap[:, k] - low) * 3 + outcome)
            keys = np.flatnonzero(n)
            parts.append(np.c_[np.full(len(keys), first + k), keys // 3 + low, keys % 3, n[keys]])
        got = np.concatenate(parts) if parts else np.empty((0, 4), np.int64)
        return pd.DataFrame({"setting": got[:, 0], "gap": got[:, 1] * width, "outcome": got[:, 2], "n": got[:, 3]})

    each = folded(contests, ladder, day, grid, told, "setting int, gap double, outcome int, n long", lambda x: x.groupby(["setting", "gap", "outcome"], as_index=False)["n"].sum())
    return each.groupBy("setting", "gap", "outcome").agg(F.sum("n").alias("n"))
