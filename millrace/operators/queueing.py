"""Which posting is served next, and how batches form."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import first_keyword
from millrace.operators.keys import joined
from millrace.sources.store import shared_table


def value_rank(ranks: dict[tuple[int, int], int], tier: Column, cls: Column, other: int = 99) -> Column:
    """The global rank of (tier, class)."""
    key = F.concat_ws("/", tier.cast("string"), cls.cast("string"))
    table = F.create_map(*(F.lit(x) for (t, c), r in ranks.items() for x in (f"{t}/{c}", r)))
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def value_pick(df: DataFrame, rank: Column, n: int = 1, seen: str = "first_seen", tie: str = "id") -> DataFrame:
    """The ``n`` rows worth most: rank, then longest waiting, then identifier. A top-k without a global sort."""
    return df.withColumn("value_rank", rank).orderBy("value_rank", F.asc_nulls_last(seen), tie).limit(n)


def head_tier(waiting: DataFrame, clocks: DataFrame) -> DataFrame:
    """The waiting tier with the oldest turn clock; one never served comes first, ties go to the lowest."""
    tiers = waiting.select("tier").distinct().join(clocks.groupBy("tier").agg(F.max("turn_at").alias("turn_at")), "tier", "left")
    return tiers.orderBy(F.asc_nulls_first("turn_at"), "tier").limit(1)


def floor_pick(df: DataFrame, cutoff: Column, covered: Column, n: int = 1, seen: str = "first_seen", tie: str = "id") -> DataFrame:
    """The longest waiting rows before ``cutoff`` that the age-out rule doesn't cover; unknown counts as not covered."""
    return df.withColumn("_covered", covered).filter((F.col(seen) < cutoff) & ~F.coalesce(F.col("_covered"), F.lit(False))).drop("_covered").orderBy(seen, tie).limit(n)


def class_of(tier: Column, title: Column, country_only: Column, strong: str, senior: str) -> Column:
    """1 or 2: a strong title that isn't senior, in a place or country-wide; 3 or 4: any other. Tier 2 ignores the place."""
    good = title.rlike(f"(?i){strong}") & ~title.rlike(f"(?i){senior}")
    wide = country_only & (tier != 2)
    return F.when(good & ~wide, 1).when(good, 2).when(~wide, 3).otherwise(4)


def title_kind(title: Column, strong: list[str], senior: list[str]) -> Column:
    """``ai`` for a title with one of the ``strong`` words and none of the ``senior`` ones, as whole words; ``other`` for the rest."""
    return F.when(first_keyword(title, strong).isNotNull() & first_keyword(title, senior).isNull(), "ai").otherwise("other")


class TitleClass(NamedTuple):
    """A class of a tier's order: its name, the kind of its titles, and whether their place is only a country (None: either)."""

    name: str
    kind: str
    country_only: bool | None = None


#: A rank behind all others, of rows without a class and of classes without a value.
UNRANKED = 99


def stored_rank(tier: Column, kind: Column, country_only: Column, orders: dict[int, list[TitleClass]], default: list[TitleClass]) -> Column:
    """The place (from 0) in the tier's order of the first class that a title's kind and place belong to; null if none does."""

    def place(classes: list[TitleClass]) -> Column:
        return F.coalesce(*(F.when((kind == c.kind) & (F.lit(True) if c.country_only is None else country_only == c.country_only), F.lit(k)) for k, c in enumerate(classes)))

    found = F.when(F.lit(False), F.lit(0))
    for number, classes in orders.items():
        found = found.when(tier == number, place(classes))
    return found.otherwise(place(default))


def value_of_rank(tier: Column, rank: Column, orders: dict[int, list[TitleClass]], default: list[TitleClass], values: dict[str, int]) -> Column:
    """The value rank of a stored rank, by its class's name, so that one class counts alike in every tier; ``UNRANKED`` for none."""
    by = lambda classes: F.coalesce(F.try_element_at(F.array(*(F.lit(values.get(c.name, UNRANKED)) for c in classes)), rank + 1), F.lit(UNRANKED))
    found = F.when(rank.isNull(), F.lit(UNRANKED))
    for number, classes in orders.items():
        found = found.when(tier == number, by(classes))
    return found.otherwise(by(default))


def fair_claim(slices: DataFrame, walks: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The due slices whose turn it is: the tier served longest ago first (never served before all), then what is due longest, then the tier.

    slices: slice, tier, due_at, active; walks: slice, walked_at. When a tier was served is the latest walk of its slices.
    """
    served = walks.join(slices.select("slice", "tier"), "slice").groupBy("tier").agg(F.max("walked_at").alias("served_at"))
    due = slices.filter(F.col("active") & (F.col("due_at") <= now)).join(served, "tier", "left")
    return due.orderBy(F.asc_nulls_first("served_at"), "due_at", "tier", "slice").limit(n)


def backfill(df: DataFrame, missing: Column, value: Column, column: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` rows first by ``order`` that lack ``column``, with it; the limit is one pass's share of the work."""
    return df.filter(missing).orderBy(*order).limit(n).withColumn(column, value)


def numbered_in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 within their keys by ``order``, however few the keys are.

    Rows are dealt out by ranges of keys and order and written; each range numbers its own, and adds how many its
    keys have in the ranges before, which is a row per range and key.
    """
    ranges = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = shared_table(ranges, df.sparkSession)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_range", before.alias("_before"))
    own = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    return joined(own, starts, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def due_batches(df: DataFrame, size: int, now: Column, patience_s: int, keys: list[str], order: list[str], changed: str = "stage_changed_at") -> DataFrame:
    """Rows of full batches, and of the last one too once the longest waiting row has waited ``patience_s``: keys, batch and place."""
    late = F.min(changed) <= now - F.make_dt_interval(secs=F.lit(float(patience_s)))
    totals = df.groupBy(*keys).agg(F.count("*").alias("_all"), late.alias("_late"))
    counted = joined(numbered_in_order(df, keys, order, "_n"), totals, keys)
    batched = counted.withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "place": (F.col("_n") % size).cast("long")})
    return batched.filter(F.col("_late") | ((F.col("batch") + 1) * size <= F.col("_all"))).drop("_n", "_all", "_late")


def zip_back(batches: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers (keys, batch, place, ...) joined to the rows of their places; rows without an answer keep nulls."""
    return batches.join(answers, [*keys, "batch", "place"], "left")


@dataclass(frozen=True)
class QueueRules:
    """How one queue is served. Times are seconds; ``ranks`` by (tier, class), what isn't in it comes last."""

    one_in: int = 8
    floor_s: float = 60 * 3600.0
    serve_every_s: float = 3600.0
    ranks: dict[tuple[int, int], int] = field(default_factory=dict)
    #: Classes and tiers that the age-out rule covers, and how long they wait before it takes them.
    aged_classes: tuple[int, ...] = ()
    aged_tiers: tuple[int, ...] = ()
    aged_s: float = 96 * 3600.0
    #: Classes of which the head tier's oldest row goes before the value order.
    urgent_classes: tuple[int, ...] = ()

    def aged(self, tier: int, cls: int) -> bool:
        return cls in self.aged_classes and tier in self.aged_tiers


class Waiting:
    """What waits, in the orders that picks ask for: heaps whose entries are dropped when they come up and are gone."""

    def __init__(self, rules: QueueRules) -> None:
        self.rules, self.rows, self.heaps, self.by_tier = rules, {}, {}, Counter()

    def _push(self, order: tuple, key: tuple, row: int) -> None:
        heapq.heappush(self.heaps.setdefault(order, []), (*key, row))

    def add(self, row: int, t: float, i: int, tier: int, cls: int) -> None:
        self.rows[row] = (t, i, tier, cls)
        self.by_tier[tier] += 1
        self._push(("value",), (self.rules.ranks.get((tier, cls), 99), t, i), row)
        self._push(("aged",) if self.rules.aged(tier, cls) else ("floor",), (t, i), row)
        if cls in self.rules.urgent_classes:
            self._push(("urgent", tier), (t, i), row)

    def first(self, *order) -> int | None:
        heap = self.heaps.get(order, [])
        while heap and heap[0][-1] not in self.rows:
            heapq.heappop(heap)
        return heap[0][-1] if heap else None

    def take(self, row: int) -> tuple[float, int, int, int]:
        self.by_tier[self.rows[row][2]] -= 1
        return self.rows.pop(row)


def simulate(arrivals: DataFrame, rules: QueueRules) -> DataFrame:
    """Serve one queue per ``host``: (host, id, t, tier, cls) -> (host, id, waited_s, kind).

    The head is the waiting tier whose turn was longest ago (never before all, then the lowest). Every ``one_in``-th pick
    of a head takes the oldest row that has waited ``floor_s`` and isn't covered by the age-out rule; else the head's
    oldest urgent row goes, else the most valuable. A pick stamps its tier's turn, a floor pick of another tier the
    head's too. Covered rows that wait too long leave as ``aged_out``. One host is folded in one pass over its
    arrivals in order of time; what waits is held.
    """

    def serve(clock: float, waiting: Waiting, turns: dict[int, float], picks: Counter) -> tuple[int, float, str] | None:
        while (row := waiting.first("aged")) is not None and clock - waiting.rows[row][0] > rules.aged_s:
            t, i, _, _ = waiting.take(row)
            return i, clock - t, "aged_out"
        tiers = [t for t, n in waiting.by_tier.items() if n]
        if not tiers:
            return None
        head = min(tiers, key=lambda t: (turns.get(t, float("-inf")), t))
        kind, row = "value", None
        if picks[head] % rules.one_in == 0 and (oldest := waiting.first("floor")) is not None and clock - waiting.rows[oldest][0] > rules.floor_s:
            kind, row = "floor", oldest
        if row is None and (urgent := waiting.first("urgent", head)) is not None:
            kind, row = "urgent", urgent
        if row is None:
            row = waiting.first("value")
        t, i, tier, _ = waiting.take(row)
        turns[tier] = clock
        if kind == "floor":
            turns[head] = clock
        picks[head] += 1
        return i, clock - t, kind

    def queue(rows: Iterator[tuple[float, int, int, int]]) -> Iterator[tuple[int, float, str]]:
        waiting, turns, picks, clock, every = Waiting(rules), {}, Counter(), None, rules.serve_every_s
        for number, (t, i, tier, cls) in enumerate(rows):
            clock = t if clock is None else clock
            while waiting.rows and clock < t:
                out = serve(clock, waiting, turns, picks)
                if out is not None:
                    yield out
                if out is None or out[2] != "aged_out":
                    clock += every
            if not waiting.rows and clock < t:
                clock += every * math.ceil((t - clock) / every)
            waiting.add(number, t, i, tier, cls)
        while waiting.rows:
            out = serve(clock, waiting, turns, picks)
            yield out
            if out[2] != "aged_out":
                clock += every

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((h, t, i, tier, cls) for part in parts for h, t, i, tier, cls in zip(part["host"], part["t"], part["id"], part["tier"], part["cls"], strict=True))
        out = []
        for host, own in groupby(rows, key=lambda r: r[0]):
            for i, waited, kind in queue(r[1:] for r in own):
                out.append((host, i, waited, kind))
                if len(out) == 20_000:
                    yield pd.DataFrame(out, columns=["host", "id", "waited_s", "kind"])
                    out = []
        yield pd.DataFrame(out, columns=["host", "id", "waited_s", "kind"])

    return arrivals.repartition("host").sortWithinPartitions("host", "t", "id").select("host", "t", "id", "tier", "cls").mapInPandas(fold, "host string, id long, waited_s double, kind string")
