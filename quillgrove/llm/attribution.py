"""Which click led to a sale: a stateful stream in which sales keep their own accumulators.

Clicks and sales arrive in batches. A click that arrives updates every buffered sale whose window
holds it; a sale that arrives begins with what the click buffer has for it; a sale that closes only
emits the count and the best click that it holds already. Clients are dealt to groups, whose buffers
are sorted arrays: all sales of a group are updated by two binary searches each, however many clicks
their windows hold. A client with many rows is cut into days of clicks, each in a group of its own;
its sales have an accumulator for each day of their window, and the parts are added up at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import NO_ID, shared_root, stored

BATCHES = 10
HOUR, DAY = 3_600_000_000, 86_400_000_000
WINDOW, DELAY = 7 * DAY, 48 * HOUR
#: Fixed values of the batches: each row whose hash is divisible by 4 comes 240 hours later.
LATE_EACH, LATE_HOURS = 4, 240
#: Rows of a group over all batches, and of a client from which on it is cut into days.
GROUP_ROWS, HEAVY_ROWS = 50_000, 20_000
CLICK, SALE, TICK = 0, 1, 2
NEVER, ALWAYS = -(1 << 62), 1 << 62

ROWS = "group int, kind int, batch int, client long, day long, id long, row long, at long, parts int, first boolean"
TOLD = "row long, sale_id long, batch int, late boolean, parts int, first boolean, best_ts long, click_id long, n_clicks long"
#: Of the state: columns of a click (client, day, ts, id) and of a sale.
CLICKS, SALES = 4, 9


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, the latter as UTC whatever the session's zone is."""
    c = F.col(at)
    wall = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return wall * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _micros(df: DataFrame, name: str) -> Column:
    return F.unix_micros(name) if dict(df.dtypes)[name] == "timestamp" else micros(name)


def _whole(at: Column, size: int) -> Column:
    """How many whole sizes a time has, in whole numbers throughout."""
    return ((at - F.pmod(at, F.lit(size))) / size).cast("long")


def cleaned(clicks: DataFrame, sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, client, at, h) of clicks, one row for each click_id, and of sales, all of them. Rows that lack a client or a time are left out.

    `h` is the hour of arrival, late ones later. A null arrival is the first hour there is; of several
    rows of a click the first by time of arrival, time and client stays.
    """

    def rows(df: DataFrame, key: str, at: str) -> DataFrame:
        late = F.when(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % LATE_EACH == 0, LATE_HOURS).otherwise(0)
        known = df.where(F.col("client_id").isNotNull() & F.col(at).isNotNull())
        return known.select(F.col(key).cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros(df, at).alias("at"), (_whole(_micros(df, "arrived_at"), HOUR) + late).alias("h"))

    one = rows(clicks, "click_id", "ts").where("id is not null").groupBy("id").agg(F.min(F.struct("h", "at", "client")).alias("r"))
    return one.select("id", "r.client", "r.at", "r.h"), rows(sales, "sale_id", "sold_at").withColumn("id", F.coalesce("id", F.lit(NO_ID)))


def watermarks(rows: DataFrame, batches: int) -> list[int]:
    """What each batch and the stream's end take for W, from rows(kind, batch, at): a pair of numbers of each batch comes to the driver."""
    most = {r.batch: (r.clicks, r.sales) for r in rows.groupBy("batch").agg(F.max(F.when(F.col("kind") == CLICK, F.col("at"))).alias("clicks"), F.max(F.when(F.col("kind") == SALE, F.col("at"))).alias("sales")).collect()}
    out, seen = [], [NEVER, NEVER]
    for b in range(batches):
        out.append(NEVER if NEVER in seen else min(seen) - DELAY)
        seen = [max(x, y if y is not None else NEVER) for x, y in zip(seen, most.get(b, (None, None)), strict=True)]
    return [*out, ALWAYS]


def dealt(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES, heavy_rows: int = HEAVY_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int]:
    """Rows of all batches, stored by batch, and the number of groups."""
    clicks, sales = cleaned(clicks, sales)
    clicks = stored(clicks, "clicks")
    low, high = clicks.agg(F.min("h"), F.max("h")).first()
    low, high = (0, 0) if low is None else (low, high)
    number = F.floor((F.coalesce("h", F.lit(low)) - low) * batches / F.lit(high - low + 1))
    batch = F.greatest(F.lit(0), F.least(F.lit(batches - 1), number)).cast("int").alias("batch")
    own = ("client", "id", "at")
    every = clicks.select(F.lit(CLICK).alias("kind"), batch, *own).unionByName(sales.select(F.lit(SALE).alias("kind"), batch, *own))
    every = stored(every.withColumn("row", F.monotonically_increasing_id()), "rows")
    heavy = stored(every.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_rows).select("client", F.lit(True).alias("heavy")), "heavy")
    met = every.join(heavy, "client", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    last = _whole(F.col("at"), DAY)
    days = F.when(~F.col("heavy"), F.array(F.lit(0).cast("long"))).when(F.col("kind") == CLICK, F.array(last)).otherwise(F.sequence(_whole(F.col("at") - WINDOW, DAY), last))
    placed = met.withColumns({"parts": F.size(days), "day": F.explode(days)})
    count = every.count()
    groups = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // group_rows))
    first = ~F.col("heavy") | (F.col("day") == last)
    group = F.pmod(F.xxhash64("client", "day"), F.lit(groups)).cast("int")
    return placed.select(group.alias("group"), "kind", "batch", "client", "day", "id", "row", "at", "parts", first.alias("first")), groups


def _ranks(units: np.ndarray, clicks: np.ndarray, order: np.ndarray, sold: np.ndarray, sale_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sale where its window begins and ends among the clicks in order of unit and time."""
    times = np.concatenate([clicks, sold, sold - WINDOW])
    rank = np.unique(times, return_inverse=True)[1].astype(np.int64)
    span = np.int64(len(times) + 1)
    n, m = len(clicks), len(sold)
    keys = (units * span + rank[:n])[order]
    return np.searchsorted(keys, sale_units * span + rank[n + m :], "left"), np.searchsorted(keys, sale_units * span + rank[n : n + m], "right")


def found(clicks: np.ndarray, sales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sale the clicks of its window: their number, and the latest one's time and id (of equally late ones the smallest).

    clicks: rows client, day, ts, id; sales: client, day, sold_at, ... A unit is a client's day.
    """
    n = clicks.shape[1]
    both = np.concatenate([clicks[:2], sales[:2]], axis=1)
    client = np.unique(both[0], return_inverse=True)[1].astype(np.int64)
    day = np.unique(both[1], return_inverse=True)[1].astype(np.int64)
    unit = client * (day.max(initial=0) + 1) + day
    unit = np.unique(unit, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((-clicks[3], clicks[2], unit[:n]))
    low, high = _ranks(unit[:n], clicks[2], order, sales[2], unit[n:])
    number = high - low
    at = np.where(number > 0, high - 1, 0)
    ts = np.where(number > 0, clicks[2][order][at] if n else NEVER, NEVER)
    ids = np.where(number > 0, clicks[3][order][at] if n else 0, 0)
    return number, ts, ids


def step(clicks: np.ndarray, sales: np.ndarray, new_clicks: np.ndarray, new_sales: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch of a group: (clicks, sales) that stay, sales that are late, sales that close.

    A sale's rows: client, day, sold_at, id, row, parts (negative unless it is the first part), count,
    best ts, best id.
    """
    new_clicks = new_clicks[:, new_clicks[2] >= mark]
    in_time = new_sales[2] >= mark
    late, new_sales = new_sales[:, ~in_time], new_sales[:, in_time]
    if sales.shape[1] and new_clicks.shape[1]:
        number, ts, ids = found(new_clicks, sales)
        better = (number > 0) & ((ts > sales[7]) | ((ts == sales[7]) & (ids < sales[8])))
        sales = np.concatenate([sales[:6], [sales[6] + number], [np.where(better, ts, sales[7])], [np.where(better, ids, sales[8])]])
    clicks = np.concatenate([clicks, new_clicks], axis=1)
    if new_sales.shape[1]:
        new_sales = np.concatenate([new_sales[:6], np.stack(found(clicks, new_sales))])
    sales = np.concatenate([sales, new_sales], axis=1)
    closing = sales[2] < mark
    return clicks[:, clicks[2] >= mark - WINDOW], sales[:, ~closing], late, sales[:, closing]


def _told(sales: np.ndarray, batch: int, late: bool) -> pd.DataFrame:
    return pd.DataFrame({
        "row": sales[4], "sale_id": sales[3], "batch": np.full(sales.shape[1], batch, np.int32), "late": late, "parts": np.abs(sales[5]).astype(np.int32), "first": sales[5] > 0,
        "best_ts": sales[7], "click_id": sales[8], "n_clicks": sales[6],
    })


def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The stream's step for one group; its tick row has the batch and W."""
    frame = pd.concat(list(frames))
    tick = frame[frame["kind"] == TICK].iloc[0]
    mark, batch = int(tick["at"]), int(tick["batch"])
    clicks, sales = (np.frombuffer(x, np.int64).reshape(k, -1) for x, k in zip(state.get if state.exists else (b"", b""), (CLICKS, SALES), strict=True))
    own = frame[frame["kind"] == CLICK]
    new_clicks = np.stack([own[c].to_numpy(np.int64) for c in ("client", "day", "at", "id")])
    own = frame[frame["kind"] == SALE]
    parts = np.where(own["first"].to_numpy(bool), 1, -1) * own["parts"].to_numpy(np.int64)
    nothing = [np.zeros(len(own), np.int64), np.full(len(own), NEVER), np.zeros(len(own), np.int64)]
    new_sales = np.stack([*(own[c].to_numpy(np.int64) for c in ("client", "day", "at", "id", "row")), parts, *nothing])
    clicks, sales, late, closed = step(clicks, sales, new_clicks, new_sales, mark)
    if clicks.shape[1] or sales.shape[1]:
        state.update((clicks.tobytes(), sales.tobytes()))
    elif state.exists:
        state.remove()
    yield _told(late[:, late[5] > 0], batch, True)
    yield _told(closed, batch, False)


def attribute(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES, heavy_rows: int = HEAVY_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(sale_id, batch, late, click_id, n_clicks) of clicks(click_id, ts, arrived_at, client_id) and sales(sale_id, client_id, sold_at, arrived_at).

    Batches by hours of arrival go one by one through one streaming query, which is started again for
    each, and once more for the end, in a new folder under spark.checkpoint.dir. Repeated clicks count
    once, repeated sales get a row each; rows without client or time are left out, as are clicks without
    an id; a null sale_id stays null; empty tables give no rows; other columns are not looked at.
    """
    spark = clicks.sparkSession
    rows, groups = dealt(clicks, sales, batches, heavy_rows, group_rows)
    folder = f"{shared_root(spark)}/attribution-{uuid.uuid4().hex}"
    rows.write.partitionBy("batch").parquet(f"{folder}/batches")
    schema = spark.createDataFrame([], ROWS).schema
    staged = spark.read.schema(schema).parquet(f"{folder}/batches")
    marks = watermarks(staged, batches)
    for batch, mark in enumerate(marks):
        ticks = spark.range(groups).select(
            F.col("id").cast("int").alias("group"), F.lit(TICK).alias("kind"), F.lit(batch).alias("batch"), *(F.lit(0).cast("long").alias(c) for c in ("client", "day", "id", "row")),
            F.lit(mark).cast("long").alias("at"), F.lit(1).alias("parts"), F.lit(False).alias("first"),
        )
        own = staged.where(F.col("batch") == batch).select(ticks.columns)
        own.unionByName(ticks.coalesce(1)).write.mode("append").parquet(f"{folder}/feed")
        fed = spark.readStream.schema(schema).parquet(f"{folder}/feed")
        told = fed.groupBy("group").applyInPandasWithState(advance, TOLD, "clicks binary, sales binary", "append", "NoTimeout")
        query = told.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/told")
        query.awaitTermination()
    told = spark.read.schema(spark.createDataFrame([], TOLD).schema).parquet(f"{folder}/told")
    best = F.min(F.struct((-F.col("best_ts")).alias("t"), "click_id")).alias("best")
    several = told.where("parts > 1").groupBy("row").agg(F.first("sale_id").alias("sale_id"), F.first("batch").alias("batch"), F.first("late").alias("late"), best, F.sum("n_clicks").alias("n_clicks"))
    several = several.select("sale_id", "batch", "late", F.col("best.click_id").alias("click_id"), "n_clicks")
    every = told.where("parts = 1").select(several.columns).unionByName(several)
    return every.select(F.nullif("sale_id", F.lit(NO_ID)).alias("sale_id"), "batch", "late", F.when(F.col("n_clicks") > 0, F.col("click_id")).alias("click_id"), "n_clicks")
