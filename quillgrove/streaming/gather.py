"""Trees of documents whose pages arrive in any batch: pages are held as state until a document is whole.

A document is whole when it has as many pages as its rows say (total_pages), or when nothing has come
for `wait`. Pages that come later, within `keep`, open it again: its tree is made anew with them. Time
is that of arrival, as the rows tell it, so a stream that is read again gives the same. A stored version
holds the documents of its batch only; the last version of a document is its tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillgrove.operators.model import Model
from quillgrove.operators.provider import Provider, by_rule
from quillgrove.plans import pipeline

WHOLE = "doc_id long, page_number int, text string, whole boolean"
NODES = "doc_id long, node_id string, parent_id string, ordinal int, depth int, structure string, title string, start_page int, end_page int, summary string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gather(StatefulProcessor):
    """Holds a document's pages; gives all of them when it is whole, when its time is up, and when one comes late.

    A page that comes again replaces the one before; if nothing in it is new, nothing is given.
    """

    def __init__(self, wait: timedelta, keep: timedelta) -> None:
        self.wait, self.keep = (int(x.total_seconds() * 1000) for x in (wait, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_number int", "text string")
        self.about = handle.getValueState("about", "total int, given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, given = self.about.get() if self.about.exists() else (0, False)
        changed, latest = False, 0
        for frame in rows:
            latest = max(latest, int(frame["arrived_at"].max().timestamp() * 1000))
            for number, text, pages in zip(frame["page_number"], frame["text"], frame["total_pages"], strict=True):
                at, text = (int(number),), None if pd.isna(text) else text
                if not self.pages.containsKey(at) or self.pages.getValue(at)[0] != text:
                    self.pages.updateValue(at, (text,))
                    changed = True
                total = max(total, 0 if pd.isna(pages) else int(pages))
        held = sum(1 for _ in self.pages.keys()) if changed else 0
        whole = changed and (given or 0 < total <= held)
        self.about.update((total, bool(given or whole)))
        self._timer(latest, self.keep if given or whole else self.wait)
        if whole:
            yield self._all(key, total <= held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, given = self.about.get()
        if given:
            self.pages.clear()
            self.about.clear()
            return
        self.about.update((total, True))
        self._timer(timerValues.getCurrentWatermarkInMs(), self.keep)
        yield self._all(key, False)

    def _timer(self, since: int, after: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(since + after)

    def _all(self, key, whole: bool) -> pd.DataFrame:
        rows = sorted((n[0], t[0]) for n, t in self.pages.iterator())
        return pd.DataFrame({"doc_id": key[0], "page_number": [n for n, _ in rows], "text": [t for _, t in rows], "whole": whole})


def gathered(pages: DataFrame, wait: timedelta = timedelta(minutes=10), keep: timedelta = timedelta(days=1), delay: str = "1 minute") -> DataFrame:
    """The pages of documents of a stream pages(doc_id, page_number, text, total_pages, arrived_at), all of a document in the batch in which it is whole.

    arrived_at is in order but for `delay`: rows further behind are dropped, as a watermark does. The
    query must be started with PROVIDER set to ROCKS.
    """
    return pages.withWatermark("arrived_at", delay).groupBy("doc_id").transformWithStateInPandas(Gather(wait, keep), WHOLE, "append", "eventTime")


def follow(pages: DataFrame, folder: str, checkpoint: str, provider: Provider | Model = by_rule, wait: timedelta = timedelta(minutes=10), keep: timedelta = timedelta(days=1), trigger: dict | None = None, **how) -> StreamingQuery:
    """Starts making the trees of a stream's documents: version b of the folder has those that batch b made whole. `how` goes to generate()."""

    def write(whole: DataFrame, batch: int) -> None:
        own = whole.select("doc_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
        nodes = pipeline.generate(own, provider, **how)
        nodes.write.mode("overwrite").parquet(f"{folder}/version={batch}")

    stream = gathered(pages, wait, keep).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    conf = pages.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)  # the query keeps the settings that it is started with
    try:
        return stream.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def trees(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each document's last version."""
    every = spark.read.schema(NODES + ", version int").parquet(folder)
    last = every.groupBy("doc_id").agg(F.max("version").alias("version"))
    return every.join(last, ["doc_id", "version"]).drop("version")
