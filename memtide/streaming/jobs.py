"""Streaming jobs. Each takes a streaming DataFrame and returns one, or a writer that is ready to start."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from memtide.functions.redact import redact
from memtide.operators import skills
from memtide.plans.lineage import cut, uncut
from memtide.sources.store import Store, bounded, upsert_skills
from memtide.streaming.ordered import in_order

TRACKED = "workspace string, event_id bigint, cluster_key string, repeat_count bigint, template string, fixed_part string, fixed_ratio double, frustration double, ready boolean"
#: Rows that a key emits at once.
EMITTED = 10_000
#: Counts of a session that are Python objects at once.
EDGES = 100_000


class Tracker(StatefulProcessor):
    """The last ``window`` commands of a workspace; emits the state of the cluster that each event falls into.

    A cluster that is ready is reported and then forgotten.
    """

    def __init__(self, window: int = 50, min_repetitions: int = 5, min_ratio: float = 0.6, threshold: float = 50.0) -> None:
        self.window, self.least, self.min_ratio, self.threshold = window, min_repetitions, min_ratio, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("last", "event_id bigint, cluster_key string, command string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = [tuple(r) for r in self.state.get()]
        told = lambda out: pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")])
        out = []
        events = (e for frame in rows for e in zip(*(frame[c].tolist() for c in ("event_id", "cluster_key", "command")), strict=True))
        for event_id, cluster, command in in_order(events):
            last = [*last, (int(event_id), cluster, command)][-self.window :]
            same = [c for _, k, c in last if k == cluster]
            # Below the least repetitions nothing can be ready, and no skeleton is made.
            template, fixed, ratio, _ = skills.skeleton(same) if len(same) >= self.least else ("", "", 0.0, 0)
            score = max(0, len(same) - self.least) * len(fixed) * ratio
            ready = ratio >= self.min_ratio and score >= self.threshold
            out.append((key[0], int(event_id), cluster, len(same), template, fixed, float(ratio), float(score), ready))
            if ready:
                last = [x for x in last if x[1] != cluster]
            if len(out) == EMITTED:
                yield told(out)
                out = []
        self.state.clear()
        if last:
            self.state.put(last)
        yield told(out)

    def close(self) -> None:
        pass


def track(events: DataFrame, window: int = 50) -> DataFrame:
    """``(workspace, event_id, tool, command)`` -> a row per event. Needs the RocksDB state store provider."""
    keyed = events.select("workspace", "event_id", skills.cluster_key(F.col("tool"), F.col("command")).alias("cluster_key"), "command")
    return keyed.groupBy("workspace").transformWithStateInPandas(Tracker(window), TRACKED, "Update", "None")


class OnlineTransitions(StatefulProcessor):
    """Transition counts of a session, one event after the other; emits each transition with its new count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "item string")
        self.counts = handle.getMapState("counts", "prev string, next string", "cnt bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.last.exists()  # a new session has no counts
        before = self.last.get()[0] if known else None
        counts: dict[tuple, int] = {}  # each edge is read and written once, not once an event
        for step, _, item in in_order(((r["step"], r["tie"], r["item"]) for r in rows), keys=2):
            if before is not None:
                edge = (before, item)
                if edge not in counts:
                    if len(counts) >= EDGES:
                        self._put(counts)
                        known = True
                    found = self.counts.getValue(edge) if known else None
                    counts[edge] = found[0] if found else 0
                counts[edge] += 1
                yield Row(session=key[0], step=step, prev=before, next=item, cnt=counts[edge])
            before = item
        self._put(counts)
        if before is not None:
            self.last.update((before,))

    def _put(self, counts: dict[tuple, int]) -> None:
        for edge, n in counts.items():
            self.counts.updateValue(edge, (n,))
        counts.clear()

    def close(self) -> None:
        pass


def online_transitions(events: DataFrame) -> DataFrame:
    """``(session, step, item[, tie])`` -> ``(session, step, prev, next, cnt)``; ``tie`` orders events of one step."""
    tie = F.col("tie") if "tie" in events.columns else F.lit(0)
    return events.select("session", "step", tie.cast("bigint").alias("tie"), "item").groupBy("session").transformWithState(OnlineTransitions(), "session string, step bigint, prev string, next string, cnt bigint", "Update", "None")


def route(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> DataStreamWriter:
    """Hands each micro-batch's events to the sink of their ``hook_event_name``; an event without one is left out."""

    def batch(df: DataFrame, _: int) -> None:
        df.persist()
        for name, sink in sinks.items():
            sink(df.where(F.col("hook_event_name") == name))
        df.unpersist()

    return events.writeStream.foreachBatch(batch)


def mine_skills(events: DataFrame, tables: Store, window: int = 50, now: str = "1970-01-01T00:00:00", inject: Callable[[str], None] | None = None) -> DataStreamWriter:
    """Tool events ``(event_id, workspace, tool, command, ok)`` -> the store's skills, batch by batch.

    Commands are redacted and kept, the last ``window`` of each workspace. Clusters that are ready become skills and are
    forgotten; outcomes of safe commands change the confidence of the skill they fit; skills whose cluster has another
    template by now get a new version. Clusters are those of one workspace. ``inject`` gets the block of active skills
    that goes into an agent's context.
    """

    def batch(df: DataFrame, _: int) -> None:
        made = []

        def kept(table: DataFrame) -> DataFrame:
            made.append(cut(table))
            return made[-1]

        by = ["workspace", "cluster_key"]
        new = kept(df.withColumn("command", redact(F.col("command"))).select("event_id", "workspace", "tool", "command", "ok"))
        last = tables.read("events").join(new.select("event_id", "workspace"), ["event_id", "workspace"], "left_anti").select(*new.columns).unionByName(new)  # a batch may come twice
        last = kept(bounded(last.withColumn("pos", F.col("event_id")), window).drop("pos").withColumn("cluster_key", skills.cluster_key(F.col("tool"), F.col("command"))))
        found = kept(skills.skeletons(last, window))
        ready = kept(skills.ready_clusters(found))
        known = kept(tables.read("skills"))
        fresh = skills.extract_skills(ready, F.lit(now)).join(known.select("id"), "id", "left_anti").select(*known.columns)
        outcomes = kept(skills.validate(new, known.withColumn("position", F.monotonically_increasing_id())))
        start = known.join(outcomes.select(F.col("skill_id").alias("id")).distinct(), "id", "left_semi")
        folded = skills.confidence_fold(outcomes, start=known.select("id", "confidence", "usage_count", "failure_count")).withColumnRenamed("skill_id", "id")
        changed = start.drop("confidence", "usage_count", "failure_count", "deprecated").join(folded, "id").withColumn("last_used", F.lit(now)).select(*known.columns)
        revised = skills.revise(known.where(~F.col("deprecated")), found).select(*known.columns).join(known.select("id"), "id", "left_anti").select(*known.columns)
        tables.write("skills", upsert_skills(known, changed).unionByName(fresh).unionByName(revised))
        tables.write("events", last.join(ready.select(*by), by, "left_anti").select("event_id", "workspace", "tool", "command", "ok"))
        if inject is not None:
            inject(skills.format_skills(skills.select_skills(tables.read("skills"))).first()["formatted"])
        for table in made:
            uncut(table)

    return events.writeStream.foreachBatch(batch)
