import random
import zlib
from datetime import datetime, timedelta

from quillgrove.llm import attribution

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, at long, row string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, kind string"
ZERO = datetime(1970, 1, 1)
us = lambda t: (t - ZERO) // timedelta(microseconds=1)


def plain(clicks, sales, batches=10):
    """Batch by batch as the stream is described, one event after the other, in plain lists."""
    hour = lambda key, at: us(at) // 3_600_000_000 + (240 if zlib.crc32(("" if key is None else str(key)).encode()) % 4 == 0 else 0)
    own = {}
    for key, ts, arrived, client, *_ in clicks:
        if None not in (key, ts, client):
            own.setdefault(key, (hour(key, arrived), us(ts), client))
    sold = [(key, client, us(at), hour(key, arrived)) for key, client, at, arrived, *_ in sales if client is not None and at is not None]
    low, high = min((h for h, *_ in own.values()), default=0), max((h for h, *_ in own.values()), default=0)
    number = lambda h: max(0, min(batches - 1, batches * (h - low) // (high - low + 1)))
    held, waiting, out, seen = [], [], [], [[], []]
    for b in range(batches):
        mark = None if not all(seen) else min(map(max, seen)) - 48 * 3_600_000_000
        new = [(ts, k, c) for k, (h, ts, c) in own.items() if number(h) == b]
        come = [(k, c, s) for k, c, s, h in sold if number(h) == b]
        held += [x for x in new if mark is None or x[0] >= mark]
        out += [(k, b, True, None, 0) for k, c, s in come if mark is not None and s < mark]
        waiting += [x for x in come if mark is None or x[2] >= mark]
        for closing in [x for x in waiting if mark is not None and x[2] < mark]:
            waiting.remove(closing)
            out.append((closing[0], b, False, *best(closing, held)))
        held = [x for x in held if mark is None or x[0] >= mark - 7 * 86_400_000_000]
        seen[0] += [x[0] for x in new]
        seen[1] += [x[2] for x in come]
    return sorted([*out, *((x[0], batches, False, *best(x, held)) for x in waiting)], key=repr)


def best(sale, held):
    _, client, sold = sale
    fits = [(-ts, k) for ts, k, c in held if c == client and sold - 7 * 86_400_000_000 <= ts <= sold]
    return (min(fits)[1] if fits else None), len(fits)


def found(spark, clicks, sales, **how):
    made = attribution.attribute(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), **how)
    assert made.columns == ["sale_id", "batch", "late", "click_id", "n_clicks"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def events(n):
    random.seed(n)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=random.randint(0, 60 * 24), seconds=random.choice((0, 0, 1)), microseconds=random.choice((0, 7)))
    clicks = []
    for k in range(n):
        ts = at()
        clicks.append((k, None if k % 37 == 0 else ts, ts + timedelta(hours=random.choice((0, 1, 30, 200))), None if k % 41 == 0 else random.choice((1, 1, 1, 2, 3)), 0, "x"))
    clicks += [clicks[5], clicks[6], clicks[6], (None, at(), at(), 1, 0, "x")]
    sales = []
    for k in range(n // 2):
        ts = at()
        sales.append((k, None if k % 29 == 0 else random.choice((1, 1, 1, 2, 4)), None if k % 31 == 0 else ts, ts + timedelta(hours=random.choice((0, 1, 100))), "x"))
    sales += [(None, 1, at(), at(), "x"), sales[3], (990, 1, clicks[1][1], at(), "x"), (991, 1, clicks[1][1] + timedelta(days=7), at(), "x")]
    return clicks, sales


def test_stream(spark):
    """Nulls in every column, repeated rows, ties in time, late rows; a client cut into days gives the same, in one group or several."""
    clicks, sales = events(300)
    expected = plain(clicks, sales)
    assert any(r[2] for r in expected) and {r[1] for r in expected} >= {3, 10} and max(r[4] for r in expected) > 5
    assert found(spark, clicks, sales) == expected
    assert found(spark, clicks, sales, heavy_rows=50, group_rows=20) == expected


def test_empty_tables(spark):
    clicks, sales = events(12)
    assert found(spark, [], []) == found(spark, clicks, []) == []
    alone = found(spark, [], sales)
    assert alone == plain([], sales) and all(r[1:] == (10, False, None, 0) for r in alone)


def test_step_keeps_the_latest():
    """The state's arithmetic alone: several units, equal times, both ends of a window."""
    import numpy as np

    clicks = np.array([[1, 1, 2, 1], [0, 0, 0, 0], [100, 100, 100, 101], [9, 4, 1, 7]])
    sales = np.array([[1, 1, 1, 3], [0, 0, 0, 0], [100, 101, 100 + attribution.WINDOW, 100]])
    number, ts, ids = attribution.found(clicks, sales)
    assert number.tolist() == [2, 3, 3, 0] and ids.tolist()[:3] == [4, 7, 7] and ts.tolist()[:3] == [100, 101, 101]
