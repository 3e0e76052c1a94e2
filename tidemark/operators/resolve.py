"""Entity resolution: schedules, names, collisions, components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.session import written

#: Tokens of the sets that a task compares with as many of another schedule.
BLOCK_TOKENS = 1 << 22


def set_jaccard(a: DataFrame, b: DataFrame, id_a: str, id_b: str, token: str) -> DataFrame:
    """Jaccard index of the token sets of all pairs that share a token: an equality join on tokens, no cross join."""
    x, y = a.select(id_a, token).distinct(), b.select(id_b, token).distinct()
    na, nb = x.groupBy(id_a).agg(F.count("*").alias("na")), y.groupBy(id_b).agg(F.count("*").alias("nb"))
    shared = x.join(y, token).groupBy(id_a, id_b).agg(F.count("*").alias("common"))
    return shared.join(na, id_a).join(nb, id_b).select(id_a, id_b, "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def mutual_best(scored: DataFrame, id_a: str, id_b: str, score: str, least: float = 0.6, ratio: float = 1.5) -> DataFrame:
    """Pairs whose score reaches ``least`` and ``ratio`` times the next best of the left side, and whose right side no other
    left side claims."""
    w = W.partitionBy(id_a).orderBy(F.desc(score), id_b)
    ranked = scored.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w))
    best = ranked.filter((F.col("__r") == 1) & (F.col(score) >= least) & (F.col("__next").isNull() | (F.col(score) >= ratio * F.col("__next")))).drop("__r", "__next")
    alone = best.groupBy(id_b).agg(F.count("*").alias("__n")).filter("__n = 1").select(id_b)
    return best.join(alone, id_b, "left_semi").select(id_a, id_b, score)


def distinct_sets(rows: DataFrame, entity: str, token: str) -> DataFrame:
    """set (sorted 64-bit hashes of tokens) and members, the entities that have it in order."""
    sets = rows.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.array_sort(F.collect_set(F.xxhash64(token))).alias("set"))
    return sets.groupBy("set").agg(F.array_sort(F.collect_list(entity)).alias("members"))


def best_two(left: Sequence[np.ndarray], right: Sequence[np.ndarray], several: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of ``left`` the first of ``right`` (none: -1) with the greatest Jaccard index of at least ``low``, that index and
    the next one (0: none); a right set of ``several`` entities is its own next one."""
    size = np.array([len(s) for s in left])
    tokens, at = np.unique(np.concatenate(left), return_inverse=True)
    by_token = np.repeat(np.arange(len(left)), size)[np.argsort(at, kind="stable")]
    edges = np.r_[0, np.cumsum(np.bincount(at, minlength=len(tokens)))]
    best, score, after = np.full(len(left), -1), np.zeros(len(left)), np.zeros(len(left))
    for r, mine in enumerate(right):
        place = np.searchsorted(tokens, mine)
        place = place[(place < len(tokens)) & (tokens[np.minimum(place, len(tokens) - 1)] == mine)]
        if not len(place):
            continue
        common = np.bincount(np.concatenate([by_token[edges[p] : edges[p + 1]] for p in place.tolist()]), minlength=len(left))
        jaccard = common / (size + len(mine) - common)
        hit = np.flatnonzero(jaccard >= low)
        s = jaccard[hit]
        better = s > score[hit]
        after[hit] = np.where(better, s if several[r] else score[hit], np.maximum(after[hit], s))
        best[hit[better]], score[hit[better]] = r, s[better]
    return best, score, after


def mutual_jaccard(a: DataFrame, b: DataFrame, id_a: str, id_b: str, token: str, least: float = 0.6, ratio: float = 1.5) -> DataFrame:
    """``mutual_best`` of ``set_jaccard``, score in ``jaccard``, without its pairs: a token that many sets have would make the square
    of their number. Entities of equal sets are compared once, blocks of at most ``BLOCK_TOKENS`` by blocks, and a block keeps two
    candidates a set. Different sets are still compared all with all, in bounded memory."""
    low = least / ratio * (1 - 1e-9)  # what is further below than that changes no verdict
    lefts, rights = (written(distinct_sets(x, i, token), "schedule-sets") for x, i in ((a, id_a), (b, id_b)))
    held = [int(x.agg(F.sum(F.size("set"))).first()[0] or 0) for x in (lefts, rights)]
    n = -(-held[0] // BLOCK_TOKENS) or 1
    m = max(-(-held[1] // BLOCK_TOKENS), min(a.sparkSession.sparkContext.defaultParallelism, held[1] // 10_000), 1)
    first = F.col("members")[0]
    blocks = F.xxhash64("set")
    x = lefts.select(first.alias("a"), "set", F.pmod(blocks, F.lit(n)).alias("l"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("r"))
    y = rights.select(first.alias("b"), "set", (F.size("members") > 1).alias("several"), F.pmod(blocks, F.lit(m)).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("l"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": x["a"][:0], "b": y["b"][:0], "score": np.empty(0), "next": np.empty(0)})
        y = y.sort_values("b", kind="stable")
        best, score, after = best_two([np.asarray(s) for s in x["set"]], [np.asarray(s) for s in y["set"]], y["several"].to_numpy(bool), low)
        got = best >= 0
        return pd.DataFrame({"a": x["a"].to_numpy()[got], "b": y["b"].to_numpy()[best[got]], "score": score[got], "next": after[got]})

    kinds = {i: d.schema[i].dataType.simpleString() for d, i in ((a, id_a), (b, id_b))}
    met = x.groupBy("l", "r").cogroup(y.groupBy("l", "r")).applyInPandas(meet, f"a {kinds[id_a]}, b {kinds[id_b]}, score double, next double")
    every = F.sort_array(F.flatten(F.collect_list(F.array("score", "next"))), False)  # two a block
    best = met.groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), "b")).alias("top"), every[1].alias("next")).filter((F.col("top.score") >= least) & (F.col("top.score") >= ratio * F.col("next")))
    claims = best.join(lefts.select(first.alias("a"), "members"), "a").select(F.explode("members").alias(id_a), F.col("top.b").alias(id_b), F.col("top.score").alias("jaccard"))
    alone = claims.groupBy(id_b).agg(F.count("*").alias("__n")).filter("__n = 1").select(id_b)
    return claims.join(alone, id_b, "left_semi").select(id_a, id_b, "jaccard")


def anchor_seed(matches_a: DataFrame, matches_b: DataFrame) -> DataFrame:
    """Pairs of entities with the same fingerprint of (day, side) in two schedules. Both: day, home, away."""
    def marks(m: DataFrame, name: str) -> DataFrame:
        return m.select(F.explode(F.array(F.struct(F.col("home").alias(name), F.concat_ws("/", "day", F.lit("h")).alias("mark")), F.struct(F.col("away").alias(name), F.concat_ws("/", "day", F.lit("a")).alias("mark")))).alias("x")).select("x.*")

    return mutual_jaccard(marks(matches_a, "a"), marks(matches_b, "b"), "a", "b", "mark")


def propagate(matches_a: DataFrame, matches_b: DataFrame, known: DataFrame, tolerance: int = 1) -> DataFrame:
    """One round of votes: contests of known opponents, on one side and within ``tolerance`` days, vote for pairing the
    other sides; the leading pair of each left entity is taken where it has twice the next one's votes."""
    def faced(m: DataFrame, me: str, other: str) -> DataFrame:
        return m.select("day", F.explode(F.array(F.struct(F.lit("h").alias("at"), F.col("home").alias(me), F.col("away").alias(other)), F.struct(F.lit("a").alias("at"), F.col("away").alias(me), F.col("home").alias(other)))).alias("x")).select("day", "x.*")

    left = faced(matches_a, "a", "opp_a").join(known.select(F.col("a").alias("opp_a"), F.col("b").alias("opp_b")), "opp_a")
    right = faced(matches_b, "b", "opp_b").withColumn("day", F.explode(F.sequence(F.col("day") - tolerance, F.col("day") + tolerance)))
    votes = left.join(right, ["day", "at", "opp_b"]).groupBy("a", "b").agg(F.count("*").cast("double").alias("votes"))
    fresh = votes.join(known.select("a"), "a", "left_anti").join(known.select("b"), "b", "left_anti")
    return mutual_best(fresh, "a", "b", "votes", 1.0, 2.0).select("a", "b")


def match_schedules(matches_a: DataFrame, matches_b: DataFrame, rounds: int | None = None, tolerances: Sequence[int] = (0, 1)) -> DataFrame:
    """a, b: entities of two schedules that are the same, from the seed and rounds of votes, for each tolerance in turn until one
    adds none (or so many). Contests of the second schedule before or after all of the first take no part."""
    span = matches_a.agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    far = max(tolerances)
    within = matches_b.crossJoin(F.broadcast(span)).filter((F.col("day") >= F.col("__first") - far) & (F.col("day") <= F.col("__last") + far)).drop("__first", "__last")  # one row
    matches_a, matches_b = written(matches_a, "schedule-a"), written(within, "schedule-b")
    known = written(anchor_seed(matches_a, matches_b).select("a", "b"), "schedule-pairs")
    for tolerance in tolerances:
        left = rounds
        while left is None or left > 0:
            more = written(propagate(matches_a, matches_b, known, tolerance), "schedule-votes")
            if more.isEmpty():
                break
            known, left = known.unionByName(more), None if left is None else left - 1
    return known


def confirmed(matches_a: DataFrame, matches_b: DataFrame, pairs: DataFrame, tolerance: int = 1, least: float = 0.9) -> DataFrame:
    """Each entity of the first schedule: a, b (null without a pair), played, ok, share and whether it is confirmed. A contest is
    ok if both sides have a pair and the second schedule has it between those, on the same sides, within ``tolerance`` days; a pair
    is confirmed if ``least`` of all contests of its entity are ok. Equal contests count each."""
    pair = pairs.select("a", "b").distinct()
    mapped = matches_a.select("day", "home", "away")
    for side in ("home", "away"):
        mapped = mapped.join(pair.select(F.col("a").alias(side), F.col("b").alias(f"__{side}")), side, "left")
    there = matches_b.select(F.col("home").alias("__home"), F.col("away").alias("__away"), F.explode(F.sequence(F.col("day") - tolerance, F.col("day") + tolerance)).alias("day")).distinct()
    seen = mapped.join(there.withColumn("__ok", F.lit(1)), ["__home", "__away", "day"], "left")
    each = seen.select(F.explode(F.array("home", "away")).alias("a"), F.coalesce("__ok", F.lit(0)).alias("__ok"))
    counts = each.groupBy("a").agg(F.count("*").alias("played"), F.sum("__ok").alias("ok"))
    share = F.col("ok") / F.col("played")
    return counts.join(pair, "a", "left").select("a", "b", "played", "ok", share.alias("share"), (F.col("b").isNotNull() & (share >= least)).alias("confirmed"))


def name_groups(names: DataFrame, name: str = "name") -> DataFrame:
    """Each distinct name with ``grp``, the least name that compatible names lead to. Names are compatible if they are equal
    after normalising or share a significant token; labels pass by tokens, so no pair of names is ever made."""
    token = F.explode(F.array_distinct(F.concat(text.significant_tokens(F.col(name)), F.array(F.concat(F.lit("="), text.normalize_name(F.col(name)))))))
    held = written(names.select(name).filter(F.col(name).isNotNull()).distinct().select(name, token.alias("token")), "name-tokens")
    label = held.select(name, F.col(name).alias("grp")).distinct()
    while True:
        by_token = held.join(label, name).groupBy("token").agg(F.min("grp").alias("least"))
        stepped = written(held.join(by_token, "token").groupBy(name).agg(F.min("least").alias("grp")), "name-groups")
        if stepped.join(label.withColumnRenamed("grp", "was"), name).filter(F.col("grp") != F.col("was")).isEmpty():
            return stepped
        label = stepped


def shared_letters(a: str, b: str) -> Column:
    """How many letters two normalised names have in common, each as often as both have it: at least what any alignment matches."""
    def times(name: str, c: str) -> Column:
        return F.length(name) - F.length(F.replace(F.col(name), F.lit(c), F.lit("")))

    return sum((F.least(times(a, c), times(b, c)) for c in " abcdefghijklmnopqrstuvwxyz0123456789"), F.lit(0))


def fuzzy_names(foreign: DataFrame, canonical: DataFrame, name: str = "name", accept: float = 0.84, review: float = 0.55) -> DataFrame:
    """Each foreign name with its best canonical name of those that share a token or the first three letters, the score and
    a verdict: accepted, review or unknown."""
    def blocks(rows: DataFrame, to: str) -> DataFrame:
        norm = text.normalize_name(F.col(name))
        keys = F.array_distinct(F.concat(F.split(norm, " "), F.array(F.substring(norm, 1, 3))))
        return rows.select(F.col(name).alias(to), norm.alias(f"{to}_n"), F.explode(keys).alias("k")).distinct()

    pairs = blocks(foreign, "foreign").join(blocks(canonical, "canonical"), "k").select("foreign", "foreign_n", "canonical", "canonical_n").distinct()
    # no pair that the ratio would accept or give to review has a greater edit distance, so the ratio is taken for few
    both = F.length("foreign_n") + F.length("canonical_n")
    near = (F.levenshtein("foreign_n", "canonical_n") <= (1 - review) * both) & (2 * shared_letters("foreign_n", "canonical_n") >= review * both)
    scored = pairs.filter(near).withColumn("score", text.matching_ratio("foreign_n", "canonical_n"))
    best = scored.groupBy("foreign").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), "canonical")).alias("b"))
    out = foreign.select(F.col(name).alias("foreign")).distinct().join(best, "foreign", "left")
    verdict = F.when(F.col("b.score") >= accept, "accepted").when(F.col("b.score") >= review, "review").otherwise("unknown")
    return out.select("foreign", F.when(F.col("b.score") >= review, F.col("b.canonical")).alias("canonical"), F.col("b.score").alias("score"), verdict.alias("verdict"))


def collisions(appearances: DataFrame) -> DataFrame:
    """Players who occur more than once in a contest, and how: in two teams, under two numbers, or repeated.
    appearances: match_id, player_id, team_id, number."""
    seen = appearances.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), F.countDistinct("team_id").alias("teams"), F.countDistinct("number").alias("numbers"))
    kind = F.when(F.col("teams") > 1, "two_teams").when(F.col("numbers") > 1, "same_team").otherwise("repeated_entry")
    return seen.filter("n > 1").withColumn("kind", kind)
