"""Per-entity event-time windows that hold up when one entity owns a large share of the rows.

A Spark window keeps every row of a partition key in one task, and a sliding RANGE frame is
evaluated again for each row. Both are replaced here:

* Sliding sums become running sums. Each event adds its value at `t` and takes it back at
  `t + w`, which gives the frame `(t - w, t]` in one pass over the sorted rows.
* Keys with more rows than `limit` are cut into time chunks. A chunk starts with carry rows
  that hold the state at the end of the chunk before it (open sums, open values, last event),
  summed up beforehand to one row per chunk, so that each chunk is a task of its own.

Rows with equal times see each other (peers are included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import HOUR
from ..session import materialize

HOT_ROWS = 2_000_000
#: Rows that one task is given where windows run; their sorts and buffers take some kilobytes a row.
TASK_ROWS = 50_000
#: Rows of a hot key that one chunk is given at most, unless a microsecond has more; several chunks fill a task evenly.
CHUNK_ROWS = 12_500
#: Chunks are tried up to 2 ** MOST_DOUBLINGS hours.
MOST_DOUBLINGS = 14
#: Hot keys beyond which their table is stored instead of collected.
COLLECTED_KEYS = 10_000
_SCALE = 1_000_000_000


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(df: DataFrame, key="entity_id", time="timestamp", limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows and a chunk width that keeps their chunks below it.

    Runs one counting job over the key and time columns, and a second one if there are hot keys. No more than rows / limit
    keys can qualify, so the answer is small enough to broadcast. None if there are none.
    """
    return sized(df, key, time, limit)[0]


def sized(df: DataFrame, key="entity_id", time="timestamp", limit: int = HOT_ROWS) -> tuple[DataFrame | None, int]:
    """`hot_keys` and the tasks that all rows are to be dealt to, from the same counting job."""
    keys = _keys(key)
    hourly = df.groupBy(*keys, F.floor(F.unix_micros(time) / HOUR).alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counts = hourly.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    found = counts.agg(F.sum("_rows").alias("rows"), F.count_if(F.col("_rows") > limit).alias("busy")).first()
    tasks = tasks_for(df, found["rows"] or 0, TASK_ROWS)
    hot = _chunk_widths(_dealt(hourly, keys, tasks), keys, limit) if found["busy"] else None
    if hot is not None:
        few = found["busy"] <= COLLECTED_KEYS
        hot = df.sparkSession.createDataFrame(hot.collect(), hot.schema) if few else materialize(hot, "hot_keys")
    return hot, tasks


def _chunk_widths(hourly: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Hot keys and the widest chunks found that hold no more rows than wanted.

    The busiest hour at full length gives a width that is surely narrow enough; a key whose rows are scattered would be
    cut into many nearly empty chunks by that. So wider ones, hours times powers of two, are tried on the hourly counts.
    """
    each, own = min(limit, CHUNK_ROWS), Window.partitionBy(*keys)
    busy = hourly.withColumns({
        "_rows": F.sum("_n").over(own),
        "_peak": F.max("_n").over(own),
        "_span": F.max("_hour").over(own) - F.min("_hour").over(own),
    }).filter(F.col("_rows") > limit)
    sure = F.greatest(F.lit(1), F.floor(F.lit(HOUR) * F.lit(each) / F.col("_peak"))).cast("bigint")
    hours = F.transform(F.sequence(F.lit(1), F.lit(MOST_DOUBLINGS)), lambda k: F.pow(F.lit(2), k).cast("bigint"))
    tried = F.filter(hours, lambda h: (h * HOUR > F.col("_width")) & (h <= F.col("_span")))
    busy = busy.withColumn("_width", sure).select(*keys, "_width", "_hour", "_n", F.explode_outer(tried).alias("_hours"))
    chunks = busy.groupBy(*keys, "_width", "_hours", F.floor(F.col("_hour") / F.col("_hours")).alias("_chunk")).agg(F.sum("_n").alias("_n"))
    widest = chunks.groupBy(*keys, "_width", "_hours").agg(F.max("_n").alias("_n"))
    wide = F.max(F.when(F.col("_n") <= each, F.col("_hours") * HOUR))
    return widest.groupBy(*keys).agg(F.greatest(F.max("_width"), wide).alias("_width"))


def tasks_for(df: DataFrame, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows: at most `each`, and work for all cores unless there are only some thousand rows."""
    return max(-(-rows // each), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 1000)), 1)


def _dealt(df: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """Rows that lie together by key. Without a number adaptive execution deals them to as many tasks as there are cores."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def _with_width(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return df.withColumn("_width", F.lit(None).cast("bigint"))
    return df.join(F.broadcast(hot), keys, "left")


def _chunk(at: Column) -> Column:
    return F.when(F.col("_width").isNotNull(), F.floor(at / F.col("_width"))).otherwise(F.lit(0)).cast("bigint")


def _weight(n: Column) -> Column:
    """n ln n in fixed point, so that sums of differences cancel exactly."""
    return F.when(n > 1, F.rint(n * F.log(n.cast("double")) * _SCALE).cast("bigint")).otherwise(F.lit(0))


def sweep(
    df: DataFrame,
    *,
    sums: dict[str, tuple[str | None, int]] | None = None,
    mixes: list[tuple[str, str, str, int]] = (),
    lags: dict[str, Column] | None = None,
    number: str | None = None,
    key="entity_id",
    time: str = "timestamp",
    event: str = "event_id",
    limit: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
    arranged: bool = False,
    keep: list[str] | None = None,
    tasks: int | None = None,
    only_hot: bool = False,
) -> DataFrame:
    """Add trailing-window columns to every row, with one shuffle of the rows.

    sums    name -> (integer column to add up, or None to count; window in microseconds)
    mixes   (name of distinct count, name of entropy, column, window)
    lags    name -> value of the previous event of the key, null on the first
    number  name of the running event number, from 1
    limit   rows above which a key is cut into chunks; None never cuts
    hot     the result of `hot_keys`, if it is known already
    arranged  the rows lie together by key already; used if no key is hot
    keep    columns to return beside the keys and the new ones; all by default
    tasks   tasks to deal the rows to, if `hot` is given or `limit` is None
    only_hot  all rows are of the keys in `hot`, so that no others are looked for
    """
    keys = _keys(key)
    if hot is None and limit is not None:
        hot, tasks = sized(df, keys, time, limit)
    wanted = dict(sums=sums or {}, mixes=list(mixes), lags=lags or {}, number=number, time=time, event=event, keep=keep, tasks=tasks)
    if hot is None:
        return _sweep(df if arranged else _dealt(df, keys, tasks), keys, False, **wanted)
    if only_hot:
        return _sweep(df.join(F.broadcast(hot), keys), keys, True, **wanted)
    cold, split = split_hot(df, hot, keys)
    return _sweep(_dealt(cold, keys, tasks), keys, False, **wanted).unionByName(_sweep(split, keys, True, **wanted))


def split_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys with their chunk width."""
    hot = F.broadcast(hot)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys)


def _sweep(
    df: DataFrame,
    keys: list[str],
    chunked: bool,
    sums: dict[str, tuple[str | None, int]],
    mixes: list[tuple[str, str, str, int]],
    lags: dict[str, Column],
    number: str | None,
    time: str,
    event: str,
    keep: list[str] | None,
    tasks: int | None,
) -> DataFrame:
    """The sweep over rows that lie together by key, or that are still to be dealt out by chunk."""
    place = [*keys, "_chunk"] if chunked else keys
    columns = [c for c in df.columns if c != "_width" and (keep is None or c in keys or c in keep)]
    ahead = [*lags, *([number] if number else [])]
    if not chunked:
        # Before the marks multiply the rows.
        order = Window.partitionBy(*keys).orderBy(F.unix_micros(time), event)
        found = {n: F.lag(c).over(order) for n, c in lags.items()}
        if number:
            found[number] = F.row_number().over(order).cast("bigint")
        df = df.withColumns(found) if found else df
        columns, ahead, lags, number = [*columns, *ahead], [], {}, None
        if not sums and not mixes:
            return df.select(*columns)
    slot = {w: i + 1 for i, w in enumerate(sorted({s[1] for s in sums.values()} | {m[3] for m in mixes}))}
    payload = [c for c in columns if c not in keys]
    kind, us = F.col("_kind"), F.unix_micros(time)
    added = sorted({c for c, _ in sums.values() if c})

    points = F.array(*[F.struct(F.lit(0).alias("_kind"), us.alias("_at"))] + [
        F.struct(F.lit(i).alias("_kind"), (us + w).alias("_at")) for w, i in slot.items()
    ])
    marks = df.select("*", F.inline(points))
    marks = marks.select(
        *keys,
        *(["_width", _chunk(F.col("_at")).alias("_chunk")] if chunked else []),
        "_kind",
        "_at",
        F.when(kind == 0, F.col(event)).alias("_id"),
        F.when(kind == 0, F.struct(*payload)).alias("_row"),
        *([F.when(kind == 0, F.struct(*[c.alias(n) for n, c in lags.items()])).alias("_last")] if lags else []),
        *[F.col(c).cast("bigint").alias(f"_x_{c}") for c in added],
        *[F.when(kind.isin(0, slot[m[3]]), F.col(m[2])).alias(f"_v{i}") for i, m in enumerate(mixes)],
    )

    def change(value: Column, window: int) -> Column:
        return F.when(kind == 0, value).when(kind == slot[window], -value)

    steps = {
        **{f"_sum_{n}": change(F.col(f"_x_{c}") if c else F.lit(1).cast("bigint"), w) for n, (c, w) in sums.items()},
        **{
            f"_size{i}": F.when(F.col(f"_v{i}").isNotNull(), change(F.lit(1).cast("bigint"), m[3]))
            for i, m in enumerate(mixes)
        },
    }
    rows = marks
    if chunked:
        for carry in _carry_rows(marks, keys, steps, len(mixes), bool(lags), tasks):
            rows = rows.unionByName(carry, allowMissingColumns=True)
        rows = _dealt(rows, place, tasks)
        steps = {n: F.when(kind == -1, F.col(f"_c{n}")).otherwise(step) for n, step in steps.items()}

    # Open count of each value after each mark, then what that mark changes in the totals.
    for i in range(len(mixes)):
        opened = steps[f"_size{i}"]
        if chunked:
            opened = F.when(kind == -1, F.col(f"_open{i}")).otherwise(opened)
        by_value = Window.partitionBy(*place, f"_v{i}").orderBy("_at", "_kind", "_id")
        rows = rows.withColumn("_after", F.sum(opened).over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
        after, before = F.col("_after"), F.col("_after") - opened
        flow = _weight(after) - _weight(before)
        new = (after > 0).cast("bigint") - (before > 0).cast("bigint")
        if chunked:
            flow = F.when(kind == -1, F.col(f"_c_flow{i}")).otherwise(flow)
            new = F.when(kind == -1, F.col(f"_c_new{i}")).otherwise(new)
        rows = rows.withColumns({f"_flow{i}": flow, f"_new{i}": new}).drop("_after")

    in_order = Window.partitionBy(*place).orderBy("_at", "_kind", "_id")
    through = Window.partitionBy(*place).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    if lags:
        before = in_order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_previous", F.last("_last", ignorenulls=True).over(before))
    if number:
        one = F.when(kind == 0, F.lit(1).cast("bigint"))
        if chunked:
            one = F.when(kind == -1, F.col("_c_number")).otherwise(one)
        rows = rows.withColumn(number, F.sum(one).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = dict(steps)
    for i in range(len(mixes)):
        totals.update({f"_mix{i}": F.col(f"_flow{i}"), f"_kinds{i}": F.col(f"_new{i}")})
    if totals:
        rows = rows.withColumns({name: F.sum(step).over(through) for name, step in totals.items()})

    out = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns]
    out += [F.col("_previous")[n].alias(n) for n in lags]
    out += [F.col(number)] if number else []
    out += [F.coalesce(F.col(f"_sum_{n}"), F.lit(0)).alias(n) for n in sums]
    for i, (distinct, entropy, _, _) in enumerate(mixes):
        n, kinds = F.col(f"_size{i}"), F.col(f"_kinds{i}")
        spread = F.log(n.cast("double")) - F.col(f"_mix{i}") / (n * F.lit(float(_SCALE)))
        out.append(F.coalesce(kinds, F.lit(0)).alias(distinct))
        out.append(F.when(kinds > 1, F.greatest(spread, F.lit(0.0))).otherwise(F.lit(0.0)).alias(entropy))
    return rows.filter(kind == 0).select(*out)


def _carry_rows(
    marks: DataFrame, keys: list[str], steps: dict[str, Column], mixes: int, lags: bool, tasks: int | None
) -> list[DataFrame]:
    """State before each chunk of the hot keys, as rows that sort ahead of the chunk."""
    split = marks.filter(F.col("_width").isNotNull())
    chunk = [*keys, "_width", "_chunk"]
    first = [F.lit(-1).alias("_kind"), (F.col("_chunk") * F.col("_width") - 1).alias("_at")]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    events = F.when(F.col("_kind") == 0, F.lit(1).cast("bigint"))
    summary = split.groupBy(*chunk).agg(
        F.sum(events).alias("_number"),
        *[F.sum(step).alias(name) for name, step in steps.items()],
    )
    if lags:
        # Dealt out first: max_by of structs sorts its rows, which may be very many where a file is read.
        ends = split.filter(F.col("_kind") == 0).select(*chunk, "_at", "_id", "_last")
        ends = _dealt(ends, [*keys, "_chunk"], tasks).groupBy(*chunk)
        ends = ends.agg(F.max_by("_last", F.struct("_at", "_id")).alias("_last"))
        summary = summary.unionByName(ends, allowMissingColumns=True)
    added, carries = ["_number", *steps], []
    for i in range(mixes):
        so_far = Window.partitionBy(*keys, f"_v{i}").orderBy("_chunk")
        so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
        after, before = F.col("_after"), F.col("_before")
        counts = (
            split.filter(F.col(f"_v{i}").isNotNull())
            .groupBy(*chunk, f"_v{i}")
            .agg(F.sum(steps[f"_size{i}"]).alias("_net"))
            .withColumn("_after", F.sum("_net").over(so_far))
            .withColumn("_before", after - F.col("_net"))
        )
        carries.append(counts.filter(before > 0).select(*chunk, *first, f"_v{i}", before.alias(f"_open{i}")))
        flows = counts.groupBy(*chunk).agg(
            F.sum(_weight(after) - _weight(before)).alias(f"_flow{i}"),
            F.sum((after > 0).cast("bigint") - (before > 0).cast("bigint")).alias(f"_new{i}"),
        )
        summary = summary.unionByName(flows, allowMissingColumns=True)
        added += [f"_flow{i}", f"_new{i}"]
    summary = summary.groupBy(*chunk).agg(
        *[F.sum(c).alias(c) for c in added],
        *([F.first("_last", ignorenulls=True).alias("_last")] if lags else []),
    )
    carries.append(
        summary.select(
            *chunk,
            *first,
            *[F.sum(c).over(earlier).alias(f"_c{c}") for c in added],
            *([F.last("_last", ignorenulls=True).over(earlier).alias("_last")] if lags else []),
        )
    )
    return carries


def attach(
    df: DataFrame, table: DataFrame, columns: dict[str, list[str]], key="entity_id", tasks: int | None = None
) -> DataFrame:
    """Add columns of a lookup table, keyed by (key, column) for each of `columns`, with one shuffle for all.

    Table rows travel with the rows of their key and hand their values over inside the task. A join per column would
    shuffle the rows once for each. A table row serves the columns it has values in. The result lies together by key;
    hot keys do not belong here, in neither table.
    """
    keys = _keys(key)
    rows = df.withColumn("_looked_up", F.lit(False))
    rows = rows.unionByName(table.withColumn("_looked_up", F.lit(True)), allowMissingColumns=True)
    rows = _dealt(rows, keys, tasks)
    for column, names in columns.items():
        group = Window.partitionBy(*keys, column)
        rows = rows.withColumns({name: F.max(name).over(group) for name in names})
    return rows.filter(~F.col("_looked_up")).drop("_looked_up")


def trailing(
    df: DataFrame,
    value: Column,
    n: int,
    *,
    name: str = "sequence",
    number: str = "event_number",
    key="entity_id",
    time: str = "timestamp",
    event: str = "event_id",
    limit: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the values of the last `n` events, oldest first, and the running event number."""
    keys, tasks = _keys(key), None
    if hot is None and limit is not None:
        hot, tasks = sized(df, keys, time, limit)
    base = (
        _with_width(df, keys, hot)
        .withColumn("_at", F.unix_micros(time))
        .withColumn("_chunk", _chunk(F.col("_at")))
        .withColumn("_value", value)
        .withColumn("_one", F.lit(1).cast("bigint"))
        .withColumn("_kind", F.lit(0))
    )
    rows, chunk_keys = base, [*keys, "_width", "_chunk"]
    if hot is not None:
        split = base.filter(F.col("_width").isNotNull())
        newest = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_at"), F.desc(event))
        ends = (
            split.select(*chunk_keys, "_at", event, "_value", F.row_number().over(newest).alias("_rank"))
            .filter(F.col("_rank") < n)
            .groupBy(*chunk_keys)
            .agg(F.sort_array(F.collect_list(F.struct("_at", event, "_value"))).alias("_ends"))
        )
        counts = split.groupBy(*chunk_keys).agg(F.sum("_one").alias("_one"))
        order = Window.partitionBy(*keys).orderBy("_chunk")
        ends_before = F.flatten(F.collect_list("_ends").over(order.rowsBetween(-(n - 1), -1)))
        carry = counts.join(ends, chunk_keys).select(
            *chunk_keys,
            F.lit(-1).alias("_kind"),
            (F.col("_chunk") * F.col("_width") - 1).alias("_at"),
            F.sum("_one").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_one"),
            F.transform(F.reverse(F.slice(F.reverse(ends_before), 1, n - 1)), lambda e: e["_value"]).alias("_ends"),
        )
        rows = base.unionByName(carry, allowMissingColumns=True)
    else:
        rows = base.withColumn("_ends", F.array().cast(f"array<{_type_of(base, '_value')}>"))
    place = [*keys, "_chunk"] if hot is not None else keys
    in_order = Window.partitionBy(*place).orderBy("_at", "_kind", event)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    here = F.collect_list("_value").over(in_order.rowsBetween(-(n - 1), 0))
    ends = F.first("_ends", ignorenulls=True).over(so_far)
    rows = _dealt(rows, place, tasks) if tasks else rows
    rows = rows.select("*", here.alias("_here"), ends.alias("_start"), F.sum("_one").over(so_far).alias(number))
    joined = F.when(F.col("_start").isNull(), F.col("_here")).otherwise(F.concat("_start", "_here"))
    last = F.when(F.size(joined) > n, F.slice(joined, -n, n)).otherwise(joined)
    return rows.filter(F.col("_kind") == 0).select(*df.columns, F.col(number), last.alias(name))


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sessions(
    df: DataFrame,
    gap: int,
    *,
    key="entity_id",
    time: str = "timestamp",
    limit: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Runs of events of a key whose steps are at most `gap` microseconds.

    Returns the key, `start_us`, `end_us` and `events`. Sessions are built inside each chunk;
    only the first and last of a chunk can touch a neighbour, and only those are merged again.
    """
    keys, tasks = _keys(key), None
    if hot is None and limit is not None:
        hot, tasks = sized(df, keys, time, limit)
    base = (
        _with_width(df.select(*keys, time), keys, hot)
        .withColumn("_at", F.unix_micros(time))
        .withColumn("_chunk", _chunk(F.col("_at")))
    )
    place = [*keys, "_width", "_chunk"] if hot is not None else keys
    base = _dealt(base, place, tasks) if tasks else base
    spot = Window.partitionBy(*place).orderBy("_at")
    opens = F.coalesce((F.col("_at") - F.lag("_at").over(spot) > gap).cast("bigint"), F.lit(1))
    inside = (
        base.withColumn("_opens", opens)
        .withColumn("_session", F.sum("_opens").over(spot.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*place, "_session")
        .agg(
            F.min("_at").alias("start_us"),
            F.max("_at").alias("end_us"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    result = [*keys, "start_us", "end_us", "events"]
    if hot is None:
        return inside.select(*result)
    cold = inside.filter(F.col("_width").isNull()).select(*result)
    split = inside.filter(F.col("_width").isNotNull()).withColumn(
        "_final", F.max("_session").over(Window.partitionBy(*place))
    )
    edge = (F.col("_session") == 1) | (F.col("_session") == F.col("_final"))
    whole = cold.unionByName(split.filter(~edge).select(*result))
    order = Window.partitionBy(*keys).orderBy("start_us")
    touching = F.coalesce(
        (F.col("start_us") - F.lag("end_us").over(order) > gap).cast("bigint"), F.lit(1)
    )
    merged = (
        split.filter(edge)
        .withColumn("_opens", touching)
        .withColumn("_session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_session")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("events").alias("events"),
        )
        .drop("_session")
    )
    return whole.unionByName(merged)
