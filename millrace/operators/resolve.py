"""Entity resolution across sources: twins, uniqueness, survivors, and the merge of one posting after the other."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import choose_canonical
from millrace.operators.ordered import running, shifted
from millrace.sources.store import shared_table

STAGES = ("expired", "filtered_out", "seen", "described", "scored", "delivered")


def _keyed(entities: DataFrame, keys: list[str], seen: str, width: int) -> DataFrame:
    """id, keys, t (seconds) and block of the entities whose keys aren't empty."""
    second = F.unix_timestamp(F.col(seen).cast("timestamp"))
    return entities.filter(" AND ".join(f"({k} IS NOT NULL AND CAST({k} AS STRING) <> '')" for k in keys)).select("id", *keys, second.alias("t"), F.floor(second / width).alias("block"))


def _beside(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))


def _accompanied(own: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of :func:`_keyed` that have another in their block or one beside it; nothing else can have a twin, so sightings of the rest need not move."""
    counted = own.groupBy(*keys, "block").agg(F.count("*").alias("n"))
    here = [counted.select(*keys, (F.col("block") + k).alias("block"), F.col("n").alias("_around"), F.lit(int(k == 0)).alias("_own")) for k in (-1, 0, 1)]
    around = here[0].unionByName(here[1]).unionByName(here[2]).groupBy(*keys, "block").agg(F.sum("_around").alias("around"), F.max("_own").alias("_own")).filter("_own = 1 AND around > 1")
    return own.join(around.select(*keys, "block", "around"), [*keys, "block"]).drop("around")


def twin_candidates(entities: DataFrame, sightings: DataFrame, keys: list[str], seen: str = "first_seen", days: int = 30, of: DataFrame | None = None) -> DataFrame:
    """(id, twin) in both directions: equal non-empty keys, first seen within ``days``, no source in common.

    entities: id, keys and ``seen``; sightings: id, source. The join is on the keys and on the block of
    ``days`` that a time falls in or next to, so one frequent key spreads over its blocks; :func:`crowded_keys` says beforehand where that is not enough. With ``of`` (id) only
    the twins of these are looked for.
    """
    width = days * 86_400
    own = _accompanied(_keyed(entities, keys, seen, width), keys)
    near = _beside(own.select(F.col("id").alias("twin"), *keys, F.col("t").alias("twin_t"), "block"))
    asking = own if of is None else own.join(of.select("id"), "id", "left_semi")
    pairs = asking.join(near, [*keys, "block"]).filter((F.col("id") != F.col("twin")) & (F.abs(F.col("t") - F.col("twin_t")) <= width)).select("id", "twin")
    s = sightings.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("source").alias("sources"))  # the sources of one entity
    with_sources = pairs.join(s, "id", "left").join(s.select(F.col("id").alias("twin"), F.col("sources").alias("others")), "twin", "left")
    return with_sources.filter(~F.coalesce(F.arrays_overlap("sources", "others"), F.lit(False))).select("id", "twin")


def crowded_keys(entities: DataFrame, keys: list[str], most: int, seen: str = "first_seen", days: int = 30) -> DataFrame:
    """keys, block, entities and pairs of the blocks for which :func:`twin_candidates` may have to look at more than ``most`` pairs, from counts alone.

    To be asked before all pairs are listed: where a key is crowded, what is unique is told by :func:`possibly_unique`, and
    what merges by :func:`resolve`, neither of which lists a crowd's pairs.
    """
    own = _keyed(entities, keys, seen, days * 86_400).groupBy(*keys, "block").agg(F.count("*").alias("entities"))
    around = _beside(own).groupBy(*keys, "block").agg(F.sum("entities").alias("around"))
    found = own.join(around, [*keys, "block"]).withColumn("pairs", F.col("entities") * (F.col("around") - 1))
    return found.filter(F.col("pairs") > most).select(*keys, "block", "entities", "pairs")


def possibly_unique(entities: DataFrame, sightings: DataFrame, keys: list[str], seen: str = "first_seen", days: int = 30) -> DataFrame:
    """The entities (id) that may have exactly one twin, told from counts alone.

    All that fall in an entity's own block are within ``days`` of it. Of those at most as many share a source with it
    as there are entities with its sources in its block and the two beside. If more than one is left, it has several
    twins for certain; with nobody in the three blocks it has none. A frequent key is settled by this without pairs.
    """
    own = _accompanied(_keyed(entities, keys, seen, days * 86_400), keys)
    in_block = own.groupBy(*keys, "block").agg(F.count("*").alias("here"))
    owned = own.join(sightings.select("id", "source").distinct(), "id")
    by_source = _beside(owned.select(*keys, "source", "block")).groupBy(*keys, "source", "block").agg(F.count("*").alias("n"))
    sharing = owned.join(by_source, [*keys, "source", "block"]).groupBy("id").agg(F.sum(F.col("n") - 1).alias("sharing"))
    counted = own.join(in_block, [*keys, "block"]).join(sharing, "id", "left")
    return counted.filter((F.col("here") - 1 - F.coalesce("sharing", F.lit(0)) <= 1)).select("id")


def unique_twins(pairs: DataFrame) -> DataFrame:
    """The pairs whose first row has exactly one candidate."""
    return pairs.groupBy("id").agg(F.min("twin").alias("twin"), F.count("*").alias("n")).filter("n = 1").select("id", "twin")


def mutual_twins(pairs: DataFrame) -> DataFrame:
    """Each pair once (keep < drop order is decided later) where both sides have exactly one candidate."""
    u = unique_twins(pairs)
    back = u.select(F.col("twin").alias("id"), F.col("id").alias("twin"))
    return u.join(back, ["id", "twin"]).filter("id < twin")


def twins_of_unique(entities: DataFrame, sightings: DataFrame, keys: list[str], seen: str = "first_seen", days: int = 30) -> DataFrame:
    """The candidates of all entities that have exactly one, and of some others: what :func:`unique_twins` needs.

    Entities that have no other near them, and their sightings, are left out first: the rest is written once and read by all that follows.
    """
    near = _accompanied(_keyed(entities, keys, seen, days * 86_400), keys).select("id")
    own = shared_table(entities.join(near, "id", "left_semi").select("id", *keys, seen), entities.sparkSession)
    met = shared_table(sightings.select("id", "source").join(own.select("id"), "id", "left_semi").distinct(), entities.sparkSession)
    return twin_candidates(own, met, keys, seen, days, possibly_unique(own, met, keys, seen, days))


def survivor_key(stage: Column, first_seen: Column, described: Column, tie: Column, stages: tuple[str, ...] = STAGES) -> Column:
    """Sorts the row to keep first: furthest stage, first seen, with a description, smallest identifier."""
    rank = F.array_position(F.array(*map(F.lit, stages)), stage)
    return F.struct((-rank).alias("stage"), first_seen.alias("first_seen"), (~described).alias("bare"), tie.alias("tie"))


def merge_groups(rows: DataFrame, group: str, key: Column, least: list[str], most: list[str], adopt: list[str]) -> DataFrame:
    """One row per group: its survivor's identifier, least and largest values, and the survivor's values or else the next one's.

    ``adopt``: the first non-null value in survivor order.
    """
    order = rows.withColumn("_key", key)
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("_key", F.col(c).alias("v")))).alias(c) for c in adopt]
    found = order.groupBy(group).agg(F.min_by("id", "_key").alias("survivor"), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(f"last_{c}") for c in most), *first)
    return found.withColumns({c: F.col(c)["v"] for c in adopt})


def merged_links(rows: DataFrame, group: str, key: Column, url: str = "url") -> DataFrame:
    """group and canonical_url: of the links of a group's rows, in survivor order, the first to a company's own page or else the first."""
    listed = F.array_sort(F.collect_list(F.when(F.col(url).isNotNull(), F.struct(key.alias("k"), F.col(url).alias("u")))))  # the few rows of one entity
    return rows.groupBy(group).agg(choose_canonical(F.transform(listed, lambda x: x["u"])).alias("canonical_url"))


class _Near:
    """The entities of one part that lie within ``width`` of the one whose turn it is, by the set of their sources and oldest first."""

    def __init__(self, width: int) -> None:
        self.width, self.by_sources = width, {}

    def add(self, t: int, own: int, sources: frozenset) -> None:
        insort(self.by_sources.setdefault(sources, []), (t, own))

    def drop(self, t: int, own: int, sources: frozenset) -> None:
        found = self.by_sources[sources]
        del found[bisect_left(found, (t, own))]
        if not found:
            del self.by_sources[sources]

    def only_twin(self, t: int, own: int, sources: frozenset) -> tuple[int, int, frozenset] | None:
        """The one entity without a source in common; none if there are several."""
        twins: list[tuple[int, int, frozenset]] = []
        for others, found in list(self.by_sources.items()):
            gone = bisect_left(found, (t - self.width,))
            if gone == len(found):
                del self.by_sources[others]
                continue
            if gone > 1_000 or 2 * gone > len(found):
                del found[:gone]
                gone = 0
            if not others & sources:
                twins += [(*x, others) for x in islice(found, gone, gone + 3) if x[1] != own]
                if len(twins) > 1:
                    return None
        return twins[0] if twins else None


def _part_in_order(rows: Iterator[tuple[int, int, frozenset]], width: int) -> Iterator[tuple[int, int]]:
    """(id, first) of one part's rows (t, id, sources), oldest first: whom each has joined, or itself."""
    near, waiting, joined_to = _Near(width), deque(), {}
    ahead = next(rows, None)
    while ahead or waiting:
        while ahead and (not waiting or ahead[0] <= waiting[0][0] + width):
            near.add(*ahead)
            waiting.append(ahead)
            ahead = next(rows, None)
        t, own, sources = waiting.popleft()
        if own not in joined_to and (twin := near.only_twin(t, own, sources)):
            (kept_t, kept, _), (_, dropped, _) = sorted([(t, own, sources), twin], key=lambda x: x[:2])
            near.drop(t, own, sources)
            near.drop(*twin)
            near.add(kept_t, kept, sources | twin[2])
            joined_to[dropped] = kept
        yield own, joined_to.pop(own, own)


def _merged_in_order(width: int):
    """A task's function over rows (part, t, id, sources), part by part and oldest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "t", "id", "sources")), strict=True))
        found = (pair for _, part in groupby(rows, itemgetter(0)) for pair in _part_in_order(((t, own, frozenset(sources)) for _, t, own, sources in part), width))
        while held := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], names=["id", "first"])

    return run


def resolve(entities: DataFrame, sightings: DataFrame, keys: list[str], seen: str = "first_seen", days: int = 30) -> DataFrame:
    """(id, root): entities have their turn one after the other, from the oldest (equally old ones by id) on.

    An entity whose turn it is merges with the one other, merged or still alone, that has its keys, was first seen within ``days`` of
    it and has no source in common with it; with none or several it stays as it is. What has merged was first seen when its
    older part was, has the sources of both, and has no further turn. The root is the smallest id. Ids are whole numbers.

    Nothing reaches over a gap of more than ``days`` in a key, so keys are cut there, by one pass over ranges of their
    order. Each part is folded as a stream that holds what lies within ``days`` of the entity whose turn it is. A part of which
    all have the same sources is left out, as nothing in it can merge.
    """
    spark, width = entities.sparkSession, days * 86_400_000_000
    have = " AND ".join(f"({k} IS NOT NULL AND CAST({k} AS STRING) <> '')" for k in keys)
    own = entities.filter(f"{have} AND {seen} IS NOT NULL").select(F.col("id").cast("long").alias("id"), *keys, F.unix_micros(F.col(seen).cast("timestamp")).alias("t"))
    sources = sightings.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_set(F.col("source").cast("string")).alias("sources"))  # the sources of one entity
    own = own.join(sources, "id", "left").withColumn("sources", F.coalesce(F.array_sort("sources"), F.array().cast("array<string>")))
    after = shifted(own, keys, ["t", "id"], {"before": F.col("t")})
    cut = running(after, keys, ["t", "id"], {"part": (F.col("before").isNull() | (F.col("t") - F.col("before") > width)).cast("int")})
    cut = shared_table(cut.withColumn("part", F.concat_ws("\x1f", *keys, F.col("part").cast("string"))).select("part", "t", "id", "sources"), spark)
    several = cut.groupBy("part").agg(F.count("*").alias("n"), F.min("sources").alias("a"), F.max("sources").alias("b")).filter("n > 1 AND (a <> b OR size(a) = 0)")
    in_order = cut.join(several.select("part"), "part", "left_semi").repartition("part").sortWithinPartitions("part", "t", "id")
    joined_to = shared_table(in_order.mapInArrow(_merged_in_order(width), "id long, first long"), spark)
    roots = joined_to.groupBy("first").agg(F.min("id").alias("root"))
    moved = joined_to.join(roots, "first").select("id", "root")
    return entities.select("id").join(moved, "id", "left").select("id", F.coalesce("root", F.col("id")).alias("root"))


def rekey(children: DataFrame, roots: DataFrame, column: str = "id") -> DataFrame:
    """Children of merged entities point at the survivors."""
    return children.join(roots.select(F.col("id").alias(column), "root"), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def sighting_rollup(sightings: DataFrame, keys: list[str], at: str, id_col: str) -> DataFrame:
    """One row per natural key: when it was first and last seen, how often, and the row that saw it first."""
    return sightings.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen_count"), F.min(F.struct(at, id_col))[id_col].alias("first_id"))


def also_seen_on(sightings: DataFrame, key: str, at: str, source: str) -> DataFrame:
    """Sources of an entity in the order they first saw it, joined by commas."""
    first = sightings.groupBy(key, source).agg(F.min(at).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", source)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[source].cast("string")), ",").alias("sources"))


def first_of_key(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """keys and values of the row that sorts first by ``order``, as an aggregate with partial sums, for hot keys."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_row")).select(*keys, *(F.col("_row")[v].alias(v) for v in values))
