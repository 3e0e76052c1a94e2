"""Operators over what happened strictly before a day. Days are integers; rows of one day never see each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def before(entity: Sequence[str], day: str, reach: int | None = None) -> W:
    """The entity's rows of earlier days, at most ``reach`` days back."""
    return W.partitionBy(*entity).orderBy(day).rangeBetween(W.unboundedPreceding if reach is None else -reach, -1)


def total_before(agg: Callable[[Column], Column], x: Column, entity: Sequence[str], day: str, reach: int | None = None) -> Column:
    """Sum or count over the entity's earlier rows, 0 without any. A bounded one is the total up to the day less the total that
    is out of reach: both frames only grow, so a row costs the same however long the reach is."""
    earlier = F.coalesce(agg(x).over(before(entity, day)), F.lit(0))
    if reach is None:
        return earlier
    out = W.partitionBy(*entity).orderBy(day).rangeBetween(W.unboundedPreceding, -reach - 1)
    return earlier - F.coalesce(agg(x).over(out), F.lit(0))


def weight(day: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), -day / F.lit(float(half_life)))


def decayed_mean(rows: DataFrame, entity: str, prior: Sequence[str], day: str, value: str, half_life: float, reach: int = 730, strength: float = 3.0, history: Column | None = None, name: str = "ewm") -> DataFrame:
    """Decayed mean of the entity's earlier values, shrunk with ``strength`` towards the mean of all rows of its ``prior``
    group in the same time; null where the entity has no earlier value. Adds ``name`` and ``{name}_weight``.

    Both are running totals over integer days; whether there is an earlier value is told by counts, which are exact. The
    prior is summed by day first, so a large group is a few rows a day.
    """
    known = F.col(value).isNotNull() if history is None else history & F.col(value).isNotNull()
    x = F.when(known, F.col(value).cast("double"))
    w = F.when(known, weight(F.col(day), half_life))
    daily = rows.groupBy(*prior, day).agg(F.sum(x).alias("__s"), F.count(x).alias("__c"))
    count = F.nullif(total_before(F.sum, F.col("__c"), prior, day, reach), F.lit(0))
    mu = daily.select(*prior, day, (total_before(F.sum, F.col("__s"), prior, day, reach) / count).alias("__mu"))
    scale = F.pow(F.lit(0.5), F.col(day) / F.lit(float(half_life)))
    some = total_before(F.count, x, [entity], day, reach) > 0
    sums = rows.withColumns({"__wx": total_before(F.sum, w * x, [entity], day, reach) * scale, "__w": F.when(some, total_before(F.sum, w, [entity], day, reach) * scale)})
    out = sums.join(mu, [*prior, day], "left")
    shrunk = (F.col("__wx") + strength * F.col("__mu")) / (F.col("__w") + strength)
    return out.withColumn(name, F.when(F.col("__w") > 0, shrunk)).withColumn(f"{name}_weight", F.coalesce("__w", F.lit(0.0))).drop("__wx", "__w", "__mu")


def days_since(rows: DataFrame, entity: str, day: str, event: Column, name: str, reach: int | None = None) -> DataFrame:
    """Days since the entity's last earlier row with ``event``; null if there is none within ``reach``."""
    gap = F.col(day) - F.max(F.when(event, F.col(day))).over(before([entity], day))
    return rows.withColumn(name, gap if reach is None else F.when(gap <= reach, gap))


def count_before(rows: DataFrame, entity: str, day: str, event: Column, reach: int, name: str) -> DataFrame:
    """How many earlier rows with ``event`` lie within ``reach`` days."""
    return rows.withColumn(name, total_before(F.count, F.when(event, 1), [entity], day, reach))


def any_before(rows: DataFrame, entity: str, day: str, event: Column, reach: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.coalesce(F.max(event).over(before([entity], day, reach)), F.lit(False)))


def last_known(rows: DataFrame, entity: str, day: str, order: str, value: str, name: str) -> DataFrame:
    """The entity's last non-null ``value`` of earlier days; of one day the greatest ``order``'s."""
    held = F.when(F.col(value).isNotNull(), F.struct(F.col(day), F.col(order), F.col(value).alias("__v")))
    return rows.withColumn(name, F.max(held).over(before([entity], day))["__v"])


def strict_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Left join with the last right row of an earlier day. Several right rows of one day: the greatest struct of values.

    A union of both sides and one ordered window, so a key is shuffled once and never multiplied out; on equal days left
    rows sort first and so do not see that day.
    """
    newest = right.groupBy(*keys, day).agg(F.max(F.struct(*values)).alias("__v"))
    tagged = left.withColumn("__v", F.lit(None).cast(newest.schema["__v"].dataType)).withColumn("__side", F.lit(0))
    both = tagged.unionByName(newest.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(W.partitionBy(*keys).orderBy(day, "__side").rowsBetween(W.unboundedPreceding, -1))
    got = both.withColumn("__got", last).filter("__side = 0")
    return got.select(*left.columns, *(F.col(f"__got.{v}").alias(f"{prefix}{v}") for v in values))


def spells(rows: DataFrame, entity: str, day: str, order: str, holder: str, cap: int = 365, new_below: int = 5) -> DataFrame:
    """Tenure of ``holder`` (gaps and islands): days since the first row of the run that an earlier day left open, at most
    ``cap``; 0 with another or no holder before; and whether it has fewer than ``new_below`` rows of that run. Rows whose
    holder is unknown take no part and get nulls."""
    known = rows.filter(F.col(holder).isNotNull())
    w = W.partitionBy(entity).orderBy(day, order)
    change = F.coalesce((F.lag(holder).over(w) != F.col(holder)).cast("int"), F.lit(0))
    runs = known.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("__start", F.min(day).over(W.partitionBy(entity, "__run"))).withColumn("__rank", F.row_number().over(W.partitionBy(entity, "__run").orderBy(day, order)))
    last_of_day = runs.groupBy(entity, day).agg(F.max_by(F.struct(F.col(holder).alias("h"), F.col("__start").alias("s"), F.col("__rank").alias("n")), F.struct(order)).alias("__last"))
    prior = last_of_day.withColumn("__prior", F.lag("__last").over(W.partitionBy(entity).orderBy(day))).select(entity, day, "__prior")
    same = F.col("__prior.h") == F.col(holder)
    out = known.join(prior, [entity, day], "left").withColumn("tenure_days", F.when(same, F.least(F.col(day) - F.col("__prior.s"), F.lit(cap))).otherwise(0))
    out = out.withColumn("rows_in_spell", F.when(same, F.col("__prior.n")).otherwise(0)).drop("__prior")
    none = F.lit(None).cast("int")
    missing = rows.filter(F.col(holder).isNull()).withColumn("tenure_days", none).withColumn("rows_in_spell", none)
    return out.unionByName(missing).withColumn("is_new", F.col("rows_in_spell") < new_below)


def overlap_previous(rows: DataFrame, entity: str, order: Sequence[str], members: str, name: str = "overlap_prev") -> DataFrame:
    """Size of the intersection with the entity's previous set."""
    previous = F.lag(members).over(W.partitionBy(entity).orderBy(*order))
    return rows.withColumn("__prev", previous).withColumn(name, F.when(F.col("__prev").isNotNull(), F.size(F.array_intersect(members, "__prev")))).drop("__prev")


def cohesion(rows: DataFrame, entity: str, order: Sequence[str], day: str, members: str, size: int, half_lives: dict[str, float | None], last: int = 10, season: str | None = None) -> DataFrame:
    """Mean pair overlap s(s-1)/(n(n-1)) with the entity's earlier sets, weighted 0.5^((rank-1)/h) by how many sets ago
    (None: equally); ``{last}``-row and same-season means besides. Sets of one day don't see each other.

    The earlier sets of a row are an ordered array in its own window, so nothing is joined; bound an entity's history by
    filtering before where it is long.
    """
    w = W.partitionBy(entity).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    held = F.struct(F.struct(*order).alias("o"), F.col(members).alias("m"), *((F.col(season).alias("s"),) if season else ()))
    past = rows.withColumn("__past", F.reverse(F.array_sort(F.collect_list(held).over(w))))

    def score(x: Column) -> Column:
        s = F.size(F.array_intersect(x["m"], F.col(members)))
        return (s * (s - 1)).cast("double") / (size * (size - 1))

    past = past.withColumn("__s", F.transform("__past", lambda x: F.struct(score(x).alias("v"), *((x["s"].alias("s"),) if season else ()))))
    none = F.size("__s") == 0

    def mean(items: Column) -> Column:
        total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["v"])
        return F.when(F.size(items) > 0, total / F.size(items))

    for name, h in half_lives.items():
        if h is None:
            out = mean(F.col("__s"))
        else:
            top = F.aggregate(F.transform("__s", lambda x, i: x["v"] * F.pow(F.lit(0.5), i / F.lit(float(h)))), F.lit(0.0), lambda a, x: a + x)
            under = F.aggregate(F.transform("__s", lambda x, i: F.pow(F.lit(0.5), i / F.lit(float(h)))), F.lit(0.0), lambda a, x: a + x)
            out = F.when(~none, top / under)
        past = past.withColumn(name, out)
    past = past.withColumn(f"cohesion_win{last}", mean(F.slice("__s", 1, last)))
    if season:
        past = past.withColumn("cohesion_reset", mean(F.filter("__s", lambda x: x["s"] == F.col(season))))
    return past.drop("__past", "__s")


def new_members(rows: DataFrame, entity: str, row_id: str, day: str, members: str, reach: int = 365, below: int = 3, name: str = "new_members") -> DataFrame:
    """How many members have fewer than ``below`` earlier rows of the entity within ``reach`` days."""
    each = rows.select(entity, row_id, day, F.explode(members).alias("__m"))
    seen = each.withColumn("__n", total_before(F.count, F.lit(1), [entity, "__m"], day, reach))
    fresh = seen.groupBy(entity, row_id).agg(F.count_if(F.col("__n") < below).alias(name))
    return rows.join(fresh, [entity, row_id], "left")


def newest_before(rows: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], values: dict[str, Column], last: int) -> DataFrame:
    """``rows`` with, for each of ``values``, the array of its last ``last`` non-null values of earlier days, newest first.

    A day's values become one sorted array; days are numbered by those that have a value, so that a frame of ``last`` numbers
    holds enough, however long a key's history is."""
    held = {name: F.collect_list(F.when(v.isNotNull(), F.struct(*order, v.alias("__x")))) for name, v in values.items()}
    newest = {name: F.transform(F.slice(F.sort_array(c, False), 1, last), lambda x: x["__x"]).alias(name) for name, c in held.items()}
    days = rows.groupBy(*keys, day).agg(*newest.values())
    for name in values:
        number = F.coalesce(F.count_if(F.size(name) > 0).over(before(keys, day)), F.lit(0)) + 1
        days = days.withColumn(f"__n_{name}", number)
    for name in values:
        frame = W.partitionBy(*keys).orderBy(f"__n_{name}").rangeBetween(-last, -1)
        earlier = F.sort_array(F.collect_list(F.when(F.size(name) > 0, F.struct(f"__n_{name}", F.col(name).alias("__a")))).over(frame), False)
        days = days.withColumn(f"__p_{name}", F.slice(F.flatten(F.transform(earlier, lambda x: x["__a"])), 1, last))
    days = days.select(*keys, day, *(F.col(f"__p_{n}").alias(n) for n in values))
    return rows.join(days, [*keys, day], "left")


def regulars_missing(rows: DataFrame, entity: str, order: str, day: str, members: str, last: int = 10, least: int = 5, name: str = "regulars_missing") -> DataFrame:
    """Share of the entity's regulars (members of at least ``least`` of its last ``last`` earlier sets) that are absent; null
    with fewer sets or no regular."""
    out = newest_before(rows, [entity], day, [order], {"__past": F.col(members)}, last)
    everyone = F.flatten("__past")
    often = F.filter(F.array_distinct(everyone), lambda m: F.size(F.filter(everyone, lambda x: x == m)) >= least)
    out = out.withColumn("__reg", F.when(F.size("__past") >= last, often))
    absent = F.size(F.array_except("__reg", F.col(members)))
    return out.withColumn(name, F.when(F.size("__reg") > 0, absent / F.size("__reg"))).drop("__past", "__reg")


def changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (nulls are equal); true at the first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    here, there = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    other = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
    gone = column.is_null().to_numpy(zero_copy_only=False)
    return np.r_[np.ones(min(len(column), 1), bool), other | (gone[1:] != gone[:-1])]


def rolling_means(batches: Iterator[pa.RecordBatch], keys: Sequence[str], day: str, values: dict[str, str], last: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows in the order of ``keys`` and ``day`` with the mean, named by ``values``, of each value's last ``last`` of
    earlier days. From one batch to the next go only the open key's last ``last`` values of earlier days and of the open day."""
    end, held, now = None, {v: np.empty(0) for v in values}, {v: np.empty(0) for v in values}
    for batch in batches:
        if not batch.num_rows:
            continue
        head = pa.Table.from_batches([batch.select([*keys, day])])
        both = pa.concat_tables([end, head]) if end is not None else head
        skip = 0 if end is None else 1
        key = np.logical_or.reduce([changes(both[k]) for k in keys])[skip:]
        new = key | changes(both[day])[skip:]
        end = head.slice(batch.num_rows - 1)
        at = np.arange(batch.num_rows)
        first_of_key, first_of_day = (np.maximum.accumulate(np.where(x, at, -1)) for x in (key, new))
        none = np.logical_or.reduce([batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in (*keys, day)])
        made = []
        for v in values:
            x, there = batch.column(v).to_numpy(zero_copy_only=False).astype(float), batch.column(v).is_valid().to_numpy(zero_copy_only=False)
            # what has been carried, then what this batch has; count[i] is how many of those are before row i
            known = np.concatenate([held[v], now[v], x[there]])
            h, c = len(held[v]), len(held[v]) + len(now[v])
            count = c + np.r_[0, np.cumsum(there)]
            low = np.where(first_of_key < 0, 0, count[np.maximum(first_of_key, 0)])
            high = np.where(first_of_day < 0, h, count[np.maximum(first_of_day, 0)])
            total, n = np.zeros(batch.num_rows), np.minimum(high - low, last)
            for k in range(1, last + 1):  # the newest first
                has = high - k >= low
                total[has] += known[high[has] - k]
            made.append(pa.array(total / np.maximum(n, 1), mask=none | (n == 0)))
            begin, open_, to = low[-1], high[-1], count[-1]
            held[v], now[v] = known[max(begin, open_ - last) : open_], known[max(open_, to - last) : to]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *values.values()])


def last_rows_mean(rows: DataFrame, keys: Sequence[str], day: str, order: str, values: Sequence[str], last: int) -> DataFrame:
    """Means of the last ``last`` rows of earlier days, null values skipped; null without any or where a key or the day is null.

    Rows are dealt by ``keys`` and sorted once; the means are made in arrays of a batch while they pass. All columns of ``rows``
    pass too, so drop before what isn't needed."""
    made = {f"__v{k}": f"{v}_last{last}" for k, v in enumerate(values)}
    sorted_ = rows.withColumns({c: F.col(v).cast("double") for c, v in zip(made, values, strict=True)}).repartition(*keys).sortWithinPartitions(*keys, day, order, *made)
    kind = StructType([*(StructField(f.name, f.dataType) for f in sorted_.schema), *(StructField(name, DoubleType()) for name in made.values())])
    return sorted_.mapInArrow(lambda batches: rolling_means(batches, keys, day, made, last), kind).drop(*made)


def percentile_rank(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """100 x average rank / count among the group's known values; ties share their mean rank, null stays null."""
    known = F.col(value).isNotNull()
    w = W.partitionBy(*group, known)
    rank = F.rank().over(w.orderBy(value))
    ties = F.count("*").over(W.partitionBy(*group, value))
    return rows.withColumn(name, F.when(known, 100.0 * (rank + (ties - 1) / 2.0) / F.count("*").over(w)))



def live_features(rows: DataFrame, asked: DataFrame, today: int, form: int = 10, expected: int = 5) -> DataFrame:
    """``asked`` (league, season, team_id, is_home) with what is known before ``today``: mean points and goals for and against of
    the side's last ``form`` contests at that venue, mean xg of its last ``expected`` with one, points, goal difference and place
    in its league's season; null where there is none. rows: played sides with goals and xg. The last rows of each side are cut
    before they are shuffled."""
    points = F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0)
    past = rows.filter(F.col("day") < today).withColumn("__p", points)
    newest = F.row_number().over(W.partitionBy("team_id", "is_home").orderBy(F.desc("day"), F.desc("match_id")))
    means = {"form_points": "__p", "form_for": "goals_for", "form_against": "goals_against"}
    last = past.withColumn("__r", newest).filter(F.col("__r") <= form).groupBy("team_id", "is_home").agg(*(F.avg(v).alias(n) for n, v in means.items()))
    xg = past.filter(F.col("xg").isNotNull()).withColumn("__r", newest).filter(F.col("__r") <= expected).groupBy("team_id", "is_home").agg(F.avg("xg").alias("form_xg"))
    table = past.groupBy("league", "season", "team_id").agg(F.sum("__p").alias("standing_points"), F.sum(F.col("goals_for") - F.col("goals_against")).alias("standing_diff"))
    table = table.withColumn("standing_place", F.row_number().over(W.partitionBy("league", "season").orderBy(F.desc("standing_points"), F.desc("standing_diff"), "team_id")))
    return asked.join(last, ["team_id", "is_home"], "left").join(xg, ["team_id", "is_home"], "left").join(table, ["league", "season", "team_id"], "left")
