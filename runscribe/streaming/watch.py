"""Watching scored runs: a folder of scorecards that are added, rewritten and removed, or a table of runs by skill."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import DIMENSIONS
from ..sources import card_folder
from ..sources.transcripts import _kind, _string

COLUMNS = ["skill", "run_id", "ts", "composite_cents"]
LAST = "skill string, last double, recent array<double>"
#: Composites of a skill that its state keeps.
WINDOW = 10


def changes(runs: DataFrame, before: DataFrame, bound: float = 5.0) -> DataFrame:
    """``runs`` of a micro-batch, and ``before`` (skill, last) -> how each run changed against the one before.

    Runs are taken in (ts, run_id) order, a null ts last; the first run of a skill is ``first``.  Each skill is
    sorted by Spark, which spills; no task holds a skill's runs.
    """
    order = Window.partitionBy("skill").orderBy(F.col("ts").asc_nulls_last(), F.col("run_id").asc_nulls_last())
    placed = runs.select(COLUMNS).withColumn("n", F.row_number().over(order)).withColumn("previous", F.lag("composite_cents").over(order))
    old = before.select(F.col("skill").alias("old_skill"), "last", F.lit(True).alias("known"))
    met = placed.join(old, F.col("skill").eqNullSafe(F.col("old_skill")), "left")
    gain = F.col("composite_cents") - F.when(F.col("n") == 1, F.col("last")).otherwise(F.col("previous"))
    gain = F.when(~F.isnan(gain), gain)
    change = F.when((F.col("n") == 1) & F.col("known").isNull(), "first").when(gain > bound, "improved").when(gain < -bound, "regressed").otherwise("flat")
    return met.select(*COLUMNS, change.alias("change"))


def last_runs(done: DataFrame, before: DataFrame) -> DataFrame:
    """skill, last, recent: each skill's last composite and last WINDOW composites (oldest first) after the runs of a micro-batch."""
    order = Window.partitionBy("skill").orderBy(F.col("ts").desc_nulls_first(), F.col("run_id").desc_nulls_first())
    ends = done.withColumn("n", F.row_number().over(order)).where(F.col("n") <= WINDOW)  # limited before the shuffle
    told = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("at"), F.col("composite_cents").cast("double").alias("c"))))
    new = ends.groupBy("skill").agg(F.transform(told, lambda x: x["c"]).alias("new"))
    old = before.select(F.col("skill").alias("old_skill"), F.lit(True).alias("known"), F.col("last").alias("old_last"), F.coalesce("recent", F.array().cast("array<double>")).alias("old"))
    met = new.join(old, F.col("skill").eqNullSafe(F.col("old_skill")), "full")
    every = F.concat(F.coalesce("old", F.array().cast("array<double>")), F.coalesce("new", F.array().cast("array<double>")))
    skill = F.when(F.col("new").isNull(), F.col("old_skill")).otherwise(F.col("skill"))
    last = F.when(F.col("new").isNull(), F.col("old_last")).otherwise(F.element_at("new", -1))
    return met.select(skill.alias("skill"), last.alias("last"), F.slice(every, F.greatest(F.size(every) - WINDOW + 1, F.lit(1)), F.lit(WINDOW)).alias("recent"))


def headers(hist: DataFrame, bound: float = 5.0) -> DataFrame:
    """skill, run_id, header: what a watcher prints of each run against the one before."""
    from ..operators import history

    counts = history.diff_counts(hist)
    gains = history.over_runs(hist, 1, lambda w: {"_before": F.lag("composite_cents").over(w)})
    now, was = (F.col("composite_cents") / 100).cast("double"), (F.col("_before") / 100).cast("double")
    gain = F.col("composite_cents") - F.col("_before")
    arrow = F.when(gain > bound, "↑").when(gain < -bound, "↓").otherwise("→")
    change = F.when(was.isNull(), F.format_string("composite %.2f (first run)", now)).otherwise(F.format_string("composite %.2f %s %.2f (%+.2f)", was, arrow, now, (gain / 100).cast("double")))
    first = was.isNull()
    n = [F.when(first, x).otherwise(F.col(c)) for c, x in (("improved", 0), ("regressed", 0), ("unchanged", 7))]
    text = F.format_string("[watch] %s: improved %d, regressed %d, unchanged %d since last run — %s", "skill", *n, change)
    return gains.join(counts, ["skill", "run_id"]).select("skill", "run_id", text.alias("header"))


def removed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file) that were there and are not any more -> file, header.  A file stream doesn't see this, so it is asked in batch."""
    return before.select("file").join(now.select("file"), "file", "left_anti").select("file", F.concat(F.lit("[watch] removed: "), "file").alias("header"))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
CHANGE = "pass_no long, file string, kind string, skill string, ts string, before double, composite double, improved int, regressed int, unchanged int"
WATCHED = f"{CHANGE}, window_runs int, window_top int, sigma double"


def cards_read(files: DataFrame) -> DataFrame:
    """(pass_no, file, kind, modified, value) -> pass_no, file, kind, modified, is_card, skill, ts, composite, scores, digest.

    A card is a JSON object.  Its skill is the file's name without its end where it names none, its composite 0 where it has none;
    a dimension's score counts if it is a number, cut to a whole one.  Two texts of one document have one digest.
    """
    v = F.try_parse_json("value")
    v = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    def number(path: str) -> F.Column:
        kind = _kind(v, path)
        return F.when(F.exists(F.array(*[F.lit(n) for n in NUMBERS]), lambda n: kind.startswith(n)), F.try_variant_get(v, path, "double"))

    scores = F.array(*[F.floor(F.abs(number(f"$.dimensions.{d}.score"))).cast("int") * F.signum(number(f"$.dimensions.{d}.score")).cast("int") for d in DIMENSIONS])
    return files.select(
        "pass_no", "file", "kind", "modified", v.isNotNull().alias("is_card"), F.coalesce(_string(v, "$.skill"), F.regexp_replace("file", r"\.[^.]*$", "")).alias("skill"),
        F.coalesce(_string(v, "$.timestamp"), F.lit("")).alias("ts"), F.coalesce(number("$.composite_score"), F.lit(0.0)).alias("composite"), scores.alias("scores"), F.md5(F.to_json(v)).alias("digest"),
    )


class CardChanges(StatefulProcessor):
    """By file: the last card as a value state; what changed against it.  A card that can't be read any more counts as removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", "skill string, ts string, composite double, scores array<int>, digest string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        seen = sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r[0])  # a row a pass
        for number, file, kind, _, is_card, skill, ts, composite, scores, digest in seen:
            old = self.card.get() if self.card.exists() else None
            if kind == "written" and is_card:
                if old is not None and old[4] == digest:
                    continue
                now = [None if s is None or s != s else int(s) for s in scores]
                was = list(old[3]) if old is not None else [None] * len(now)
                pairs = [(a, b) for a, b in zip(was, now, strict=True) if a is not None and b is not None]
                up, down = sum(b > a for a, b in pairs), sum(b < a for a, b in pairs)
                if old is not None and old[0] != skill:
                    out.append((number, file, "moved", old[0], old[1], old[2], None, None, None, None))
                out.append((number, file, "first" if old is None else "changed", skill, ts, None if old is None else old[2], composite, up, down, len(now) - up - down))
                self.card.update((skill, ts, composite, now, digest))
                continue
            if kind == "written":
                out.append((number, file, "broken", None, None, None, None, None, None, None))
            if old is not None:
                out.append((number, file, "removed", old[0], old[1], old[2], None, None, None, None))
                self.card.clear()
        yield pd.DataFrame(out, columns=["pass_no", "file", "kind", "skill", "ts", "before", "composite", "improved", "regressed", "unchanged"]).astype(object)

    def close(self) -> None:
        pass


class SkillWindow(StatefulProcessor):
    """By skill: the last WINDOW runs by (ts, file) as a list state.  Changes pass through; a row ``window`` says how these runs stand after them.

    What is kept doesn't depend on the order in which a pass's changes arrive: of the runs held before, WINDOW at most can go, so
    twice as many are held until all changes are seen.  A removed run leaves a gap that only later runs fill.
    """

    def __init__(self, top: float):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "ts string, file string, composite double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {file: (ts, file, composite) for ts, file, composite in self.runs.get()}
        before, gone, number = set(held), set(), 0
        for frame in rows:  # frames pass through one by one
            for r in frame.itertuples(index=False):
                number = max(number, r[0])
                if r[2] in ("removed", "moved"):
                    if r[1] in before:
                        gone.add(r[1])
                    else:
                        held.pop(r[1], None)
                elif r[2] in ("first", "changed"):
                    held[r[1]] = (r[4], r[1], r[6])
                    gone.discard(r[1])
            held = {x[1]: x for x in sorted(held.values())[-2 * WINDOW :]}
            yield frame.assign(window_runs=None, window_top=None, sigma=None).astype(object)
        held = {x[1]: x for x in sorted(x for x in held.values() if x[1] not in gone)[-WINDOW:]}
        if held:
            self.runs.put(list(held.values()))
        else:
            self.runs.clear()
        kept = [x[2] for x in held.values()]
        sigma = float(pd.Series(kept).std(ddof=0)) if kept else None
        if key[0] is not None:  # files that never could be read have no skill
            yield pd.DataFrame([(number, None, "window", key[0], None, None, None, None, None, None, len(kept), sum(x >= self.top for x in kept), sigma)], columns=[*frame.columns, "window_runs", "window_top", "sigma"]).astype(object)

    def close(self) -> None:
        pass


def watched(files: DataFrame, top: float = 8.5) -> DataFrame:
    """A stream of (pass_no, file, kind, modified, value) -> WATCHED: changes of cards, and each changed skill's last runs.

    Two keyed states in a RocksDB store: a card a file, at most WINDOW runs a skill.  A skill's changes of a micro-batch are
    one task's, which lets them pass in Arrow batches.  Files that broke have no skill; they and what they replace are rows too.
    """
    changes = cards_read(files).groupBy("file").transformWithStateInPandas(CardChanges(), CHANGE, "Append", "None")
    return changes.groupBy("skill").transformWithStateInPandas(SkillWindow(top), WATCHED, "Append", "None")


def header_of() -> F.Column:
    """What a watcher prints of a change; null for rows that aren't printed.  A gain of five hundredths is flat, whatever its double."""
    now, was = F.col("composite"), F.col("before")
    gain = F.round(now - was, 9)
    arrow = F.when(gain > 0.05, "↑").when(gain < -0.05, "↓").otherwise("→")
    change = F.when(F.col("kind") == "first", F.format_string("composite %.2f (first run)", now)).otherwise(F.format_string("composite %.2f %s %.2f (%+.2f)", was, arrow, now, gain))
    text = F.format_string("[watch] %s: improved %d, regressed %d, unchanged %d since last run — %s", "skill", "improved", "regressed", "unchanged", change)
    return F.when(F.col("kind").isin("first", "changed"), text).when(F.col("kind") == "removed", F.concat(F.lit("[watch] removed: "), "file"))


def collapsed_of(least: int = 5, share: float = 0.95, spread: float = 0.3) -> F.Column:
    """Whether a ``window`` row's runs are nearly all at the top and hardly differ; null for other rows."""
    n = F.col("window_runs")
    return F.when(F.col("kind") == "window", F.coalesce((n >= least) & (F.col("window_top") / n >= share) & (F.col("sigma") < spread), F.lit(False)))


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, out: str, interval: str | None = None, top: float = 8.5):
    """Follow a folder of scorecards and add what changed to ``out`` as Parquet.

    Without ``interval`` one pass is made: what differs from the last pass of this checkpoint, or is there at all, is handled and
    the query ends; with one ("2 seconds") the folder is listed that often until the returned query is stopped.
    """
    card_folder.register(spark)
    files = spark.readStream.format(card_folder.NAME).option("path", folder).option("passes", f"{checkpoint}/passes").load()
    rows = watched(files, top).withColumns({"header": header_of(), "collapsed": collapsed_of()})
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{checkpoint}/query")
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    try:
        query = writer.start()
        if interval is None:
            query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query


def watch_once(runs: DataFrame, checkpoint: str, out: str) -> None:
    """Handle all runs that are there, write their changes as Parquet, and stop; a later call goes on from there.

    ``out`` has a folder batch=N for each micro-batch, and ``checkpoint`` each skill's last composite after it; a
    micro-batch that is done again replaces both.
    """

    def follow(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(LAST).parquet(f"{checkpoint}/last/{n - 1}") if n else spark.createDataFrame([], LAST)
        changes(batch, before).write.mode("overwrite").parquet(f"{out}/batch={n}")
        last_runs(spark.read.parquet(f"{out}/batch={n}"), before).write.mode("overwrite").parquet(f"{checkpoint}/last/{n}")

    runs.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
