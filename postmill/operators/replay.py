"""Replay of logs: what state a case is in after its events, before and after each of them, and at any time.

An event is a table from state to state, and such tables compose associatively. A log is cut into blocks of ``FAN`` events,
blocks are composed to one table each, tables of ``FAN`` blocks to one again, up to a single table a case; going down again,
each block learns the state that it starts in. So a case with a third of all events is replayed in pieces of equal size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.threads import _written

#: Events in a block, and blocks below a node.
FAN = 256


@dataclass(frozen=True)
class Machine:
    """States, the first of which is where a case starts; and for each event where it leads from a state. All other pairs change nothing."""

    states: Sequence[str]
    moves: Mapping[str, Mapping[str, str]]

    def table(self, event: Column) -> Column:
        """The numbers of the states that ``event`` leads to, by the number of the state before; unknown and null events lead nowhere."""
        number = {s: k for k, s in enumerate(self.states)}
        numbers = lambda moves: F.array(*[F.lit(number[moves.get(s, s)]) for s in self.states])
        if not self.moves:
            return numbers({})
        known = F.create_map(*[x for e, moves in sorted(self.moves.items()) for x in (F.lit(e), numbers(moves))])
        return F.coalesce(F.try_element_at(known, event), numbers({}))

    def name(self, number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), number + 1)


def _identity(machine: Machine) -> Column:
    return F.array(*[F.lit(k) for k in range(len(machine.states))])


def _composed(machine: Machine, tables: Column, table) -> Column:
    """One table for ``tables`` in their order; ``table`` gives that of an element."""
    return F.aggregate(tables, _identity(machine), lambda m, x: F.transform(m, lambda s: F.element_at(table(x), s + 1)))


def _befores(tables: Column, first: Column, table) -> Column:
    """The state before each element of ``tables``, and the last one's after it, if the first starts in ``first``."""
    return F.aggregate(tables, F.array(first), lambda seen, x: F.concat(seen, F.array(F.element_at(table(x), F.element_at(seen, -1) + 1))))


def _numbered(log: DataFrame) -> DataFrame:
    """``log`` with ``k``, the place of an event in its case from 0, without a task that sees all events of a case.

    The log is cut into even ranges of case and time. Only the first case of a range can reach back into an earlier one, so
    the table of those that do has at most two rows a range, which is what is broadcast.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = log.repartitionByRange(parts, "key", "at", "ask", "id").withColumn("range", F.spark_partition_id())
    cut = cut.withColumn("k", F.row_number().over(Window.partitionBy("range", "key").orderBy("at", "ask", "id")) - 1)
    return cut.select("key", "range", F.col("k").cast("long").alias("k"), "at", "ask", "id", "event")


def _blocks(log: DataFrame, machine: Machine, folder: str) -> DataFrame:
    """(key, node, events, table, n, last_at): the log in blocks of up to FAN events of a case, written to ``folder``."""
    numbered = _written(_numbered(log), folder)  # its ranges are read twice and must be the same
    sizes = numbered.groupBy("key", "range").agg(F.count("*").alias("n"))
    cut = sizes.join(sizes.groupBy("key").agg(F.count("*").alias("ranges")).where("ranges > 1").select("key"), "key", "left_semi")
    start = F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.select("key", "range", F.coalesce(start, F.lit(0)).alias("from"))
    k = F.col("k") + F.coalesce("from", F.lit(0))
    placed = numbered.join(F.broadcast(offsets), ["key", "range"], "left").withColumn("k", k)
    events = F.array_sort(F.collect_list(F.struct("k", "at", "ask", "id", "event")))
    blocks = placed.groupBy("key", F.floor(F.col("k") / FAN).alias("node")).agg(events.alias("events"))
    asked = F.size(F.filter("events", lambda e: e["ask"]))
    last = F.array_max(F.transform(F.filter("events", lambda e: ~e["ask"]), lambda e: e["at"]))
    table = _composed(machine, F.transform("events", lambda e: machine.table(e["event"])), lambda m: m)
    return _written(blocks.select("key", "node", "events", table.alias("table"), (F.size("events") - asked).cast("long").alias("n"), last.alias("last_at")), folder)


def _levels(blocks: DataFrame, machine: Machine, folder: str) -> list[DataFrame]:
    """The blocks, and above them nodes of up to FAN tables each, for the cases that have more than one node below."""
    levels = [blocks]
    while True:
        below = levels[-1].select("key", "node", "table", "n", "last_at")
        more = below.where("node > 0").select("key").distinct()
        if more.isEmpty():
            return levels
        nodes = below.join(more, "key", "left_semi").groupBy("key", F.floor(F.col("node") / FAN).alias("node"))
        up = nodes.agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("child"), "table"))).alias("children"), F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
        levels.append(_written(up.withColumn("table", _composed(machine, F.col("children"), lambda c: c["table"])), folder))


def _log(log: DataFrame, key: str, at: str, id: str, event: str) -> DataFrame:
    rows = log.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(False).alias("ask"), F.col(id).alias("id"), F.col(event).alias("event")).where("key is not null")
    return rows.groupBy("key", "at", "ask", "id").agg(F.min("event").alias("event"))


def replay(log: DataFrame, machine: Machine, folder: str, key: str, at: str, id: str, event: str) -> DataFrame:
    """(key, state, n_events, last_at): the state of each case after its whole log, in the order of time and id, whatever the order of the rows.

    Rows that agree in key, time and id are one event; of several event names the lowest counts. Rows without a key are
    left out; a null time is before all others, and a null id before the others of its time. Events that the machine does
    not know count and change nothing. Other columns are not read. An empty log gives no case. Working tables lie in
    ``folder``, a path that all executors share; the result reads them.
    """
    levels = _levels(_blocks(_log(log, key, at, id, event), machine, folder), machine, folder)
    tops = [level.where("node = 0").select("key", F.struct(F.lit(k).alias("level"), "table", "n", "last_at").alias("top")) for k, level in enumerate(levels)]
    rows = tops[0]
    for more in tops[1:]:
        rows = rows.unionByName(more)
    top = rows.groupBy("key").agg(F.max_by("top", "top.level").alias("top"))
    return top.select(F.col("key").alias(key), machine.name(F.element_at("top.table", 1)).alias("state"), F.col("top.n").alias("n_events"), F.col("top.last_at").alias("last_at"))


def _traced(rows: DataFrame, machine: Machine, folder: str) -> DataFrame:
    levels = _levels(_blocks(rows, machine, folder), machine, folder)
    entered = None  # (key, node, first): the state that a node starts in; those that are not there start in the first state
    for level in reversed(levels):
        first = F.lit(0)
        if entered is not None:
            level, first = level.join(entered, ["key", "node"], "left"), F.coalesce("first", F.lit(0))
        if "events" in level.columns:
            states = _befores(F.transform("events", lambda e: machine.table(e["event"])), first, lambda m: m)
            steps = level.select("key", "events", states.alias("states"))
            each = F.transform("events", lambda e, k: F.struct(e["k"].alias("k"), e["at"].alias("at"), e["ask"].alias("ask"), e["id"].alias("id"), e["event"].alias("event"), F.get("states", k).alias("before"), F.get("states", k + 1).alias("after")))
            return steps.select("key", F.inline(each))
        states = _befores(F.col("children"), first, lambda c: c["table"])
        below = level.select("key", "children", states.alias("states"))
        entered = below.select("key", F.inline(F.transform("children", lambda c, k: F.struct(c["child"].alias("node"), F.get("states", k).alias("first")))))


def trace(log: DataFrame, machine: Machine, folder: str, key: str, at: str, id: str, event: str) -> DataFrame:
    """(key, step, at, id, event, before, after): each event of each case with the states around it; step counts from 1. Rows as in ``replay``."""
    rows = _traced(_log(log, key, at, id, event), machine, folder)
    return rows.select(F.col("key").alias(key), (F.col("k") + 1).alias("step"), F.col("at").alias(at), F.col("id").alias(id), F.col("event").alias(event), machine.name(F.col("before")).alias("before"), machine.name(F.col("after")).alias("after"))


def as_of(log: DataFrame, moments: DataFrame, machine: Machine, folder: str, key: str, at: str, id: str, event: str, moment: str = "moment") -> DataFrame:
    """(key, moment, state): the state of a case at each of ``moments`` (key, moment), events of that very time included.

    A moment goes into the log as an event that changes nothing, after the others of its time, so there is no join by
    time. Repeated moments are one; a case without events before a moment is in the first state; moments without a key or
    a time are left out. Rows of the log as in ``replay``.
    """
    events = _log(log, key, at, id, event)
    asked = moments.select(F.col(key).alias("key"), F.col(moment).alias("at")).where("key is not null and at is not null").distinct()
    kinds = dict(events.dtypes)
    asks = asked.select(F.col("key").cast(kinds["key"]).alias("key"), F.col("at").cast(kinds["at"]).alias("at"), F.lit(True).alias("ask"), F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast(kinds["event"]).alias("event"))
    rows = _traced(events.unionByName(asks), machine, folder)
    return rows.where("ask").select(F.col("key").alias(key), F.col("at").alias(moment), machine.name(F.col("after")).alias("state"))


def timeline(steps: DataFrame, key: str, at: str) -> DataFrame:
    """(key, stage, entered_at, left_at, times): when a case first came into each stage and last left it, from a ``trace``; null if it never left."""
    moved = steps.where("before <> after")
    came = moved.select(key, F.col("after").alias("stage"), F.col(at).alias("came"), F.lit(None).cast(dict(steps.dtypes)[at]).alias("went"))
    went = moved.select(key, F.col("before").alias("stage"), F.lit(None).cast(dict(steps.dtypes)[at]).alias("came"), F.col(at).alias("went"))
    return came.unionByName(went).groupBy(key, "stage").agg(F.min("came").alias("entered_at"), F.max("went").alias("left_at"), F.count("came").alias("times"))
