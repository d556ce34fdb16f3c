"""Progress reports: interval log, status at a minute or at a completion point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadflow.functions.scalars import SPEED_CLASSES_KPH, decimal_comma, percentage
from roadflow.operators.ordering import dense_sequence, global_rank, running_total, with_neighbours
from roadflow.session import cut_lineage, discard

SEGMENT = ["node_from", "node_to"]
ALTERNATIVES = ["default", "dijkstra_fastest", "dijkstra_shortest", "plateau_fastest"]
SELECTIONS = ["no_alternative", "first", "random", "ptdr"]
CLASS_NAMES = [
    f"{low}_{high}" for low, high in zip(SPEED_CLASSES_KPH, [*SPEED_CLASSES_KPH[1:], "inf"])
]


def interval_rows(prepared: DataFrame, width_s: int, block_s: int = 3600) -> DataFrame:
    """Prepared one-second rows with interval number, driving time and the neighbouring records.

    Times count from the first record (``at_s``).  ``driving_s`` is the time to
    the next record inside the interval; the last record drives on to the
    interval end unless the vehicle arrived, and a vehicle already on the road
    also gets the time since the interval began.
    """
    t0 = prepared.agg(F.min("frame").alias("t0")).first()["t0"]
    rows = prepared.withColumn("at_s", F.col("frame") - t0).withColumn("interval", F.floor(F.col("at_s") / width_s))
    paired = with_neighbours(
        rows, ["vehicle_id"], ["at_s"], F.floor(F.col("at_s") / block_s), ["at_s", "interval"], "prev", "next"
    )
    begin = F.col("interval") * width_s
    end = begin + width_s
    stays = F.col("next.interval") == F.col("interval")
    until = F.when(stays, F.col("next.at_s")).when(F.col("active"), end).otherwise(F.col("at_s"))
    entered = F.when(F.col("prev.interval") < F.col("interval"), F.col("at_s") - begin).otherwise(0)
    return paired.withColumn("driving_s", until - F.col("at_s") + entered).withColumn(
        "weight_s", F.when(F.col("driving_s") == 0, 1).otherwise(F.col("driving_s"))
    )


def _dense_intervals(facts: DataFrame) -> DataFrame:
    bounds = facts.agg(F.lit(0).cast("bigint").alias("low"), F.max("interval").alias("high"))
    return dense_sequence(bounds, "low", "high", "interval")


_COEFFICIENTS = ["w0", "w1", "t0", "t1", "d0"]
_MEASURES = ["present", "arrived", "meters", "driving_s", "weight_s", "weighted"]


def interval_facts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Everything the log needs, summed per interval and key (vehicle or segment).

    Besides the measures of the interval this holds speed weights since the
    start as linear functions of the interval end: a record that has no
    successor yet drives until the interval end ``b``, so its weight is
    ``b - at_s``.  Each record enters with the coefficients of ``b`` and, in the
    interval of its successor, is replaced by its final weight.  Weighted speed
    is ``w0 + w1*b``, weight ``t0 + t1*b``, driving time ``d0 + t1*b``, each
    summed over the intervals so far.
    """
    at, v, active = F.col("at_s"), F.col("speed_mps"), F.col("active")
    zero_l = F.lit(0).cast("bigint")
    opened = F.struct(
        F.col("interval").alias("interval"),
        F.lit(1).cast("bigint").alias("present"), F.when(active, 0).otherwise(1).cast("bigint").alias("arrived"),
        F.col("meters_driven").alias("meters"), F.col("driving_s").cast("bigint").alias("driving_s"),
        F.col("weight_s").cast("bigint").alias("weight_s"), (v * F.col("weight_s")).alias("weighted"),
        F.when(active, -v * at).otherwise(v).alias("w0"), F.when(active, v).otherwise(F.lit(0.0)).alias("w1"),
        F.when(active, -at).otherwise(1).cast("bigint").alias("t0"),
        F.when(active, 1).otherwise(0).cast("bigint").alias("t1"),
        F.when(active, -at).otherwise(zero_l).alias("d0"),
    )
    gap = F.col("next.at_s") - at
    closed = F.struct(
        F.col("next.interval").alias("interval"), zero_l.alias("present"), zero_l.alias("arrived"),
        F.lit(0.0).alias("meters"), zero_l.alias("driving_s"), zero_l.alias("weight_s"), F.lit(0.0).alias("weighted"),
        (v * gap - F.col("o.w0")).alias("w0"), (-F.col("o.w1")).alias("w1"),
        (gap - F.col("o.t0")).alias("t0"), (-F.col("o.t1")).alias("t1"), (gap - F.col("o.d0")).alias("d0"),
    )
    events = rows.withColumn("o", opened).select(
        *key, F.explode(F.when(F.col("next").isNull(), F.array("o")).otherwise(F.array(F.col("o"), closed))).alias("e")
    )
    return events.select(*key, "e.*").groupBy("interval", *key).agg(
        *[F.sum(c).alias(c) for c in _MEASURES + _COEFFICIENTS]
    )


def both_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts per vehicle and per segment; the interval rows are computed once and then removed."""
    rows = cut_lineage(rows)
    facts = cut_lineage(interval_facts(rows, ["vehicle_id"])), cut_lineage(interval_facts(rows, SEGMENT))
    discard(rows)
    return facts


def _first_time(facts: DataFrame, key: list[str], flag: str, name: str) -> DataFrame:
    """Keys by the first interval with the flag; their running sum is a running distinct count."""
    return (
        facts.where(F.col(flag) > 0).groupBy(*key).agg(F.min("interval").alias("interval"))
        .groupBy("interval").agg(F.count("*").alias(name))
    )


def interval_log(
    by_vehicle: DataFrame, by_segment: DataFrame, width_s: int, vehicles: DataFrame | None = None
) -> DataFrame:
    """One row per interval: within the interval and since the start.

    Takes ``interval_facts`` per vehicle and per segment.
    ``vehicles(vehicle_id, alternatives, route_selection)`` adds the counts per
    routing behaviour.
    """
    facts, here = by_vehicle, F.col("present") > 0
    counts: dict[str, Column] = {}
    if vehicles is not None:
        facts = facts.join(vehicles, "vehicle_id", "left")
        for column, names, prefix in (
            ("alternatives", ALTERNATIVES, "alternative"), ("route_selection", SELECTIONS, "selection")
        ):
            counts |= {f"{prefix}_{x}": F.count_if(here & (F.col(column) == x)) for x in names}
    per_interval = facts.groupBy("interval").agg(
        F.count_if(here).alias("vehicles"),
        F.count_if(F.col("arrived") > 0).alias("finished"),
        *[F.sum(c).alias(c) for c in _MEASURES[2:] + _COEFFICIENTS],
        *[c.alias(n) for n, c in counts.items()],
    )
    # The parts meet in one aggregate over their union instead of a chain of joins.
    stacked = _dense_intervals(by_vehicle)
    for part in (
        per_interval,
        by_segment.groupBy("interval").agg(F.count_if(here).alias("segments")),
        _first_time(by_vehicle, ["vehicle_id"], "present", "new_vehicles"),
        _first_time(by_vehicle, ["vehicle_id"], "arrived", "new_finished"),
        _first_time(by_segment, SEGMENT, "present", "new_segments"),
    ):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    log = stacked.groupBy("interval").agg(*[F.sum(c).alias(c) for c in stacked.columns if c != "interval"])
    log = running_total(
        log.fillna(0), [], ["interval"], F.floor(F.col("interval") / 4096),
        {
            "vehicles_since_start": F.col("new_vehicles"), "finished_since_start": F.col("new_finished"),
            "segments_since_start": F.col("new_segments"), "meters_since_start": F.col("meters"),
            **{f"sum_{c}": F.col(c) for c in _COEFFICIENTS},
        },
    )
    end = (F.col("interval") + 1) * width_s

    def kph(weighted: Column, weight: Column) -> Column:
        return F.try_divide(weighted, weight) * 3.6

    return log.select(
        "interval",
        (end / 60).cast("bigint").alias("offset_minutes"),
        F.col("vehicles").alias("active_vehicles"), F.col("vehicles_since_start").alias("active_vehicles_since_start"),
        *counts,
        F.col("finished").alias("finished_vehicles"), F.col("finished_since_start").alias("finished_vehicles_since_start"),
        F.bround("meters").cast("bigint").alias("meters"),
        F.bround("meters_since_start").cast("bigint").alias("meters_since_start"),
        F.bround(F.col("driving_s") / 60).cast("bigint").alias("driving_minutes"),
        F.bround((F.col("sum_d0") + F.col("sum_t1") * end) / 60).cast("bigint").alias("driving_minutes_since_start"),
        "segments", "segments_since_start",
        kph(F.col("weighted"), F.col("weight_s")).alias("average_speed_kph"),
        kph(F.col("sum_w0") + F.col("sum_w1") * end, F.col("sum_t0") + F.col("sum_t1") * end).alias(
            "average_speed_kph_since_start"
        ),
    )


def _class_counts(speed_mps: Column) -> list[Column]:
    """Counts per speed class; the bounds are compared in metres per second."""
    bounds = [c / 3.6 for c in SPEED_CLASSES_KPH] + [10000]
    return [
        F.count_if((speed_mps >= low) & (speed_mps < high)).alias(f"class_{name}")
        for name, low, high in zip(CLASS_NAMES, bounds, bounds[1:])
    ]


def interval_speed_classes(facts: DataFrame) -> DataFrame:
    """Per interval: how many vehicles (or segments) had a mean speed in each class."""
    means = facts.where("present > 0").select("interval", (F.col("weighted") / F.col("weight_s")).alias("v"))
    return means.groupBy("interval").agg(*_class_counts(F.col("v")))


def total_speed_classes(facts: DataFrame, key: list[str], width_s: int) -> DataFrame:
    """The same since the start.

    Between two intervals with records of a key its mean speed is a fraction of
    linear functions of the interval end, which only rises or only falls, so it
    crosses each class bound at most once.  A stretch therefore counts from its
    begin, at the crossing and at its end, and running sums over the intervals
    make the counts; no interval looks at the stretches it lies in.
    """
    last = facts.select(F.max("interval")).scalar()
    per_key = W.partitionBy(*key).orderBy("interval")
    upto = per_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    states = facts.select(
        F.col("interval").alias("begin"), *[F.sum(c).over(upto).alias(c) for c in _COEFFICIENTS],
        F.coalesce(F.lead("interval").over(per_key) - 1, last).alias("until"),
    )
    bounds = [c / 3.6 for c in SPEED_CLASSES_KPH] + [10000.0]

    def reaches(k: Column, bound: float) -> Column:
        end = (k + 1) * width_s
        return (F.col("w0") + F.col("w1") * end) / (F.col("t0") + F.col("t1") * end) >= bound

    def changes(number: int, bound: float) -> Column:
        before, after = reaches(F.col("begin"), bound), reaches(F.col("until"), bound)
        end = F.try_divide(bound * F.col("t0") - F.col("w0"), F.col("w1") - bound * F.col("t1"))
        near = F.floor(F.least(F.greatest(F.coalesce(end, F.lit(0.0)) / width_s - 1, F.col("begin").cast("double")), F.col("until").cast("double"))).cast("bigint")
        # The formula places the crossing up to rounding; the neighbours are asked themselves.
        found = F.filter(F.transform(F.array(*[F.lit(d) for d in range(-1, 3)]), lambda d: near + d),
                         lambda k: (k > F.col("begin")) & (k <= F.col("until")) & (reaches(k, bound) == after))
        crossing = F.coalesce(F.array_min(found), F.col("until"))
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        was, becomes = F.when(before, one).otherwise(none), F.when(after, one).otherwise(none)

        def event(k: Column, delta: Column) -> Column:
            return F.struct(k.cast("bigint").alias("interval"), F.lit(number).alias("bound"), delta.alias("delta"))

        return F.array(event(F.col("begin"), was), event(crossing, becomes - was), event(F.col("until") + 1, -becomes))

    events = states.select(F.inline(F.flatten(F.array(*[changes(n, b) for n, b in enumerate(bounds)])))).where("delta <> 0")
    names = [f"n{n}" for n in range(len(bounds))]
    steps = events.groupBy("interval").agg(
        *[F.sum(F.when(F.col("bound") == n, F.col("delta")).otherwise(0)).alias(name) for n, name in enumerate(names)])
    dense = _dense_intervals(facts).join(steps, "interval", "left").fillna(0, names)
    counts = running_total(dense, [], ["interval"], F.floor(F.col("interval") / 4096), {f"at_{n}": F.col(n) for n in names})
    return counts.select("interval", *[
        (F.col(f"at_{low}") - F.col(f"at_{high}")).alias(f"class_{name}") for name, low, high in zip(CLASS_NAMES, names, names[1:])])


# Header texts of the comparison file.
def comparison_header() -> list[str]:
    classes = [f"{n.replace('_', ' - ')} km/h" for n in CLASS_NAMES]
    head = ["time offset (minutes)", "number of active vehicles in time interval", "number of active vehicles since start"]
    head += [f"number of active vehicles with {a} alternative route algorithm" for a in ALTERNATIVES]
    head += [f"number of active vehicles with {s} route selection" for s in SELECTIONS]
    head += [
        "number of vehicles that finished journey in time interval",
        "number of vehicles that finished journey since start",
        "meters driven in time interval", "meters driven since start",
        "driving time in time interval (minutes)", "driving time since start (minutes)",
        "number of segments visited in time interval", "number of segments visited since start",
        "average speed in time interval (km/h)", "average speed since start (km/h)",
    ]
    for what in ("segments", "vehicles"):
        for when in ("in time interval", "since start"):
            head += [f"number of {what} with average speed in range {c} {when}" for c in classes]
    return head


def comparison_table(prepared: DataFrame, width_s: int, vehicles: DataFrame) -> DataFrame:
    """The comparison file as one text column per header, one row per interval (plus ``interval``)."""
    by_vehicle, by_segment = both_facts(interval_rows(prepared, width_s))
    table = interval_log(by_vehicle, by_segment, width_s, vehicles)
    for prefix, classes in (
        ("s_in_", interval_speed_classes(by_segment)),
        ("s_all_", total_speed_classes(by_segment, SEGMENT, width_s)),
        ("v_in_", interval_speed_classes(by_vehicle)),
        ("v_all_", total_speed_classes(by_vehicle, ["vehicle_id"], width_s)),
    ):
        renamed = classes.select("interval", *[F.col(f"class_{n}").alias(f"{prefix}{n}") for n in CLASS_NAMES])
        table = table.join(renamed, "interval", "left")
    body = [c for c in table.columns if c != "interval"]
    texts = []
    for c in body:
        if c.startswith("average_speed_kph"):
            texts.append(decimal_comma(F.coalesce(F.bround(c, 2), F.lit(float("nan")))))
        else:
            texts.append(F.coalesce(F.col(c), F.lit(0)).cast("string"))
    return table.select("interval", *[t.alias(h) for t, h in zip(texts, comparison_header(), strict=True)])


# --- status of a run ---------------------------------------------------------------------------

def real_time_s(records: DataFrame) -> DataFrame:
    """Time from the first to the last appended record (append order, not time order)."""
    return records.agg(
        (F.max_by("timestamp", "seq") - F.min_by("timestamp", "seq")).alias("real_time_s"),
        F.min("timestamp").alias("start"),
    )


def status_at_minute(records: DataFrame, minute: int) -> DataFrame:
    """Vehicles started, beyond their first segment and finished by a minute of the run."""
    run = real_time_s(records).first()
    limit = run["start"] + minute * 60
    per_segment = records.groupBy("vehicle_id", *SEGMENT).agg(
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("latest"),
        F.max(F.struct("timestamp", "seq", "active")).alias("end"),
    )
    per_vehicle = per_segment.groupBy("vehicle_id").agg(
        F.count_if(F.col("first") <= limit).alias("segments"),
        ((F.max("latest") <= limit) & ~F.max("end")["active"]).alias("finished"),
    )
    total = per_vehicle.agg(
        F.count("*").alias("vehicles"),
        F.count_if(F.col("segments") > 0).alias("started"),
        F.count_if(F.col("segments") > 1).alias("left_first_segment"),
        F.count_if("finished").alias("finished"),
        F.bround(F.avg("segments"), 2).alias("mean_segments"),
        F.bround(F.avg(F.when(~F.col("finished"), F.col("segments"))), 2).alias("mean_segments_unfinished"),
    )
    n = F.col("vehicles")
    return total.select(
        F.lit(minute).cast("bigint").alias("minute"),
        percentage(F.lit(minute), F.lit(run["real_time_s"] / 60)).alias("minute_pct"),
        "vehicles",
        "started", percentage(F.col("started"), n).alias("started_pct"),
        "left_first_segment", percentage(F.col("left_first_segment"), n).alias("left_first_segment_pct"),
        "finished", percentage(F.col("finished"), n).alias("finished_pct"),
        "mean_segments", "mean_segments_unfinished",
    )


def status_at_completion(records: DataFrame, share: float) -> DataFrame:
    """Replay in time order until the given share of vehicles has finished."""
    share = min(max(share, 0.0), 1.0)
    run = real_time_s(records).first()
    vehicles = records.select("vehicle_id").distinct().count()
    needed = math.ceil(share * vehicles)
    order = ["timestamp", "vehicle_id", "seq"]
    at = F.struct(*order)
    ranked = global_rank(
        records.where(~F.col("active")).select(*order), order, F.floor(F.col("timestamp") / 3600)
    )
    cut = ranked.where(F.col("rank") == needed).select(*order).first() if needed else None
    if needed == 0:
        replayed = records.where(F.lit(False))
    elif cut is None:
        replayed = records
    else:
        replayed = records.where(at <= F.struct(*[F.lit(cut[c]).cast("bigint").alias(c) for c in order]))
    firsts = replayed.groupBy("vehicle_id", *SEGMENT).agg(F.min(F.struct("timestamp", "seq")).alias("f"))
    arrivals = firsts.select("vehicle_id", "f.timestamp", "f.seq", F.lit(1).cast("bigint").alias("new"), F.lit(0).alias("done"))
    ends = replayed.where(~F.col("active")).select(
        "vehicle_id", "timestamp", "seq", F.lit(0).cast("bigint").alias("new"), F.lit(1).alias("done")
    )
    seen = running_total(
        arrivals.unionByName(ends), ["vehicle_id"], ["timestamp", "seq", "done"], F.floor(F.col("timestamp") / 3600),
        {"segments": F.col("new")},
    )
    per_vehicle = seen.groupBy("vehicle_id").agg(
        F.sum("new").alias("segments"),
        F.sum("done").alias("ends"),
        F.sum(F.when(F.col("done") == 1, F.col("segments")).otherwise(0)).alias("segments_at_end"),
        F.max("timestamp").alias("latest"),
    )
    latest = replayed.agg(F.coalesce(F.max("timestamp"), F.lit(run["start"])).alias("t")).first()["t"]
    minute = round((latest - run["start"]) / 60)
    zero = F.lit(0).cast("bigint")
    n = F.lit(vehicles)
    total = per_vehicle.agg(
        F.coalesce(F.sum("ends"), zero).alias("finished"),
        F.count_if(F.col("segments") > 0).alias("started"),
        F.count_if(F.col("segments") > 1).alias("left_first_segment"),
        F.coalesce(F.sum("segments"), zero).alias("segments"),
        F.coalesce(F.sum("segments_at_end"), zero).alias("segments_at_end"),
    )
    open_count = n - F.col("finished")
    return total.select(
        "finished", open_count.cast("bigint").alias("remaining"),
        F.lit(minute).cast("bigint").alias("minute"),
        percentage(F.lit(minute), F.lit(run["real_time_s"] / 60)).alias("minute_pct"),
        "started", percentage(F.col("started"), n).alias("started_pct"),
        "left_first_segment", percentage(F.col("left_first_segment"), n).alias("left_first_segment_pct"),
        F.bround(F.col("segments") / n, 2).alias("mean_segments"),
        F.bround(F.try_divide(F.col("segments") - F.col("segments_at_end"), open_count), 2).alias("mean_segments_unfinished"),
    )


# --- enrichment --------------------------------------------------------------------------------

def enrich(frame_rows: DataFrame, edges: DataFrame, interval_s: int, offset_s: int = 0) -> DataFrame:
    """Average speed, volume and service percentage per frame row; a missing edge is an error.

    ``edges(node_from, node_to, max_speed, ...)`` has one row per segment.
    """
    count = F.col("speed_count_first") + F.col("speed_count_second")
    total = (F.col("speed_sum_first") + F.col("speed_sum_second")) * 3.6
    average = F.when(count > 0, total / F.nullif(count, F.lit(0))).otherwise(0.0)
    joined = frame_rows.join(
        edges.select(*SEGMENT, "max_speed", F.lit(True).alias("__known")), SEGMENT, "left"
    )
    known = F.when(F.col("__known").isNull(), F.raise_error(F.lit("Edge not found in graph")).cast("double"))
    return joined.select(
        (F.col("frame_id") * interval_s + offset_s).alias("timestamp"),
        *SEGMENT,
        average.alias("average_speed"),
        (F.col("count_unique_first") + F.col("count_unique_second")).alias("volume"),
        F.coalesce(known, F.col("max_speed")).alias("max_speed"),
    ).withColumn("los", service_percent(F.col("average_speed"), F.col("max_speed")))


def service_percent(average: Column, limit: Column) -> Column:
    """Whole per cent, truncated; noise below 1e-9 from the order of summation does not decide."""
    return F.round(F.try_divide(average, limit) * 100.0, 9).cast("bigint")


def edge_metadata(edges: DataFrame, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per segment from several maps, and the count of conflicting copies.

    ``edges(node_from, node_to, max_speed, highway, geometry, position)``; the
    lowest ``position`` wins.  ``used`` limits the result to segments in use.
    """
    rows = edges if used is None else edges.join(used.select(*SEGMENT).distinct(), SEGMENT, "left_semi")
    variant = ["max_speed", "highway", "geometry"]
    copies = rows.groupBy(*SEGMENT, *variant).agg(F.min("position").alias("position"), F.count("*").alias("copies"))
    chosen = copies.groupBy(*SEGMENT).agg(
        F.min(F.struct("position", *variant, "copies")).alias("w"), F.sum("copies").alias("copies")
    ).withColumn("conflicts", F.col("copies") - F.col("w.copies"))
    return chosen.select(*SEGMENT, *[f"w.{c}" for c in variant]), chosen.select(*SEGMENT, "conflicts")


# --- run metrics -------------------------------------------------------------------------------

def step_parts(steps: DataFrame) -> DataFrame:
    """Total time per phase from ``parts`` maps."""
    return steps.select(F.explode("parts").alias("part", "ms")).groupBy("part").agg(F.sum("ms").alias("total_ms"))


def recent_step_mean(steps: DataFrame, last: int = 50) -> DataFrame:
    """Mean duration of the latest steps."""
    return steps.orderBy(F.desc("step")).limit(last).agg(F.avg("duration_ms").alias("mean_ms"))
