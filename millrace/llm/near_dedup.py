"""Near-duplicates by fast similarity sketches, banding and exact verification.

Documents with one set of shingles become a class first, whatever its size. The classes' sketches are cut
into bands; classes that share a band are joined by star edges to the smallest, never by all pairs, and
the star edges' components hold every pair that banding proposes. The texts of a component then meet in
bounded blocks, where links are found on the words of the full sets by a search that compares a document
only with those that nothing has reached yet. A component of one block is settled by that.

A larger one is parted first, as texts that have a passage in common are candidates in chains without being
alike. Shingles are put in an order in which those that are frequent among the group come last. Two linked sets
share one of their first shingles at least, of which each has as many as it may have besides those that it
must share; so texts are parted by the components of star edges over their first shingles, which a common
passage doesn't reach, and no link is lost whatever the order. In a part that still fills more than a block the
blocks' own components meet by their smallest members next; what is linked by then is dealt into blocks
of its own, and two blocks are only compared where they hold texts that aren't linked yet. So a large group
of near copies costs one pass over its texts, not one for each pair of blocks.

With the default 64 bands of 8 coordinates a pair of similarity 0.85 is missed with probability 2e-9, one
of 0.8 with 8e-6, and one of 0.5 is proposed with 0.22. Equal sets are told by 128-bit digests of words and
shingles, links by comparing words.

Defined cases: texts without words (null and empty ones too) have an empty set and are linked with
nothing; a null identifier is linked with nothing and keeps component null; rows that share an identifier
count as linked; further columns are ignored; an empty table gives no rows. A word or text of any length is
taken whole; it has to fit in a task's memory, and nothing of it but digests is kept between batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ROW, numbered, slim, small, written
from millrace.llm.components import connected_components
from millrace.llm.shingles import Digests, band_keys, exact_sets, shingle_hashes, sketch

SKETCHES = "doc_id long, n_shingles long, high long, low long, bands array<long>"
LINKS = "node long, root long"
FIRSTS = "key long, rep long, root long"
#: First blocks of which a block of a large group's texts is made, and the part of one such block whose shingles are counted.
WIDE, COUNTED = 16, 4
#: Parts that the texts with one first shingle are dealt into, so that a shingle of very many texts meets none of its tasks alone.
PARTS = 64


def sketches(df: DataFrame, words: int, bands: int, rows_per_band: int) -> DataFrame:
    """Per document: the size of its set, the set's 128-bit digest and the keys of its bands (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        names = [x.split()[0] for x in SKETCHES.split(", ")]
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sizes, sets, keys = [], [], []
                for one, other in shingle_hashes(batch.column("text").to_pylist(), words, digests):
                    sizes.append(max(len(one), len(other)))
                    sets.append(hashlib.blake2b(one.tobytes() + other.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(sketch(one, bands * rows_per_band), bands) if len(one) else np.empty(0, np.int64))
                halves = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
                begins = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begins), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists], names=names)

    return df.mapInArrow(run, SKETCHES)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, by links of ``percent`` similarity, exactly.

    A breadth-first search over an inverted index of the sets not reached yet; the index is rebuilt when
    half of them have been reached, so near copies leave it at once.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    many, token = len(names), token.astype(np.int32)
    del names
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    root, reached = np.arange(n), np.zeros(n, bool)

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        keep = np.flatnonzero(~reached[owner])
        order = keep[np.argsort(token[keep], kind="stable")]
        return owner[order], np.concatenate([[0], np.cumsum(np.bincount(token[order], minlength=many))]), int(n - reached.sum())

    holders, at, left = index()
    unreached = left
    for seed in range(n):
        if reached[seed]:
            continue
        reached[seed], queue = True, [seed]
        unreached -= 1
        while queue and unreached:
            d = queue.pop()
            mine = token[begins[d] : begins[d + 1]]
            first, count = at[mine], at[mine + 1] - at[mine]
            total = int(count.sum())
            if not total:
                continue
            hit = holders[np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
            common = np.bincount(hit, minlength=n)
            found = np.flatnonzero((common > 0) & ~reached & (100 * common >= percent * (sizes[d] + sizes - common)))
            if len(found):
                reached[found], root[found] = True, seed
                queue += found.tolist()
                unreached -= len(found)
                if unreached < left // 2:
                    holders, at, left = index()
    return root


def _verified(words: int, percent: int):
    """A function of the rows (rep, label, text) that meet in one task: links between them, where the labels differ."""

    def verify(table: pa.Table) -> pa.Table:
        # of one identifier with several texts each counts
        ids, labels = (np.asarray(table.column(x)) for x in ("rep", "label"))
        order = np.argsort(ids, kind="stable")
        raw = table.column("text").to_pylist()
        sets = exact_sets([raw[k] for k in order], words)
        held = [k for k, x in enumerate(sets) if len(x)]
        out = np.empty((0, 2), np.int64)
        if held:
            root = linked([sets[k] for k in held], percent)
            at, of = ids[order][held], labels[order][held]
            new = (of != of[root]) & (at != at[root])
            out = np.stack([at, at[root]], axis=1)[new]
        return pa.table({"node": pa.array(out[:, 0], pa.int64()), "root": pa.array(out[:, 1], pa.int64())})

    return verify


def _dealt(df: DataFrame, key: str | Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def first_shingles_of(shingles: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least shingles of a set, by their count and then by value, one of which any set linked with it has among its own least.

    ``shingles`` and ``frequent`` ascend; a shingle that isn't ``frequent`` counts 0. A linked set shares at least
    ``percent`` of these shingles, so all but one of as many may be left out.
    """
    n = len(shingles)
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    count = np.where(frequent[at] == shingles, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, count))[: n - -(-percent * n // 100) + 1]]


def _frequent(words: int):
    """A function of some texts of a group: the shingles that several of them have, with the number of those texts."""

    def count(table: pa.Table) -> pa.Table:
        sets = [x for x, _ in shingle_hashes(table.column("text").to_pylist(), words)]
        shingles, many = np.unique(np.concatenate(sets), return_counts=True)
        held = many > 1
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (shingles[held].view(np.int64), many[held])]
        return pa.table({"group": table.column("group").slice(0, 1), "k": table.column("k").slice(0, 1), "frequent": lists[0], "counts": lists[1]})

    return count


def _firsts(words: int, percent: int, first_shingles: int):
    """A function of a block of a large group and its frequent shingles: links within first blocks (``key`` null), and (key, rep) of the first shingles.

    Texts that are linked in the block stand by one of them, so that copies bring a shingle once.
    """

    def run(block: pa.Table, lists: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("key", "rep", "root")})
        frequent, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        if lists.num_rows:
            frequent, counts = (lists.column(x).combine_chunks().flatten().to_numpy() for x in ("frequent", "counts"))
            frequent = frequent.view(np.uint64)
            order = np.argsort(frequent)
            frequent, counts = frequent[order], counts[order]
        ids, sizes = (np.asarray(block.column(x)) for x in ("rep", "n"))
        order = np.argsort(ids, kind="stable")
        texts = block.column("text")
        linked_pairs, of = [], ids.copy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes[order]) // first_shingles)) + 1, [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[a:b]
            root = linked(exact_sets([texts[int(k)].as_py() for k in mine], words), percent)
            of[mine] = ids[mine][root]
            new = of[mine] != ids[mine]
            linked_pairs.append(np.stack([ids[mine][new], of[mine][new]], axis=1))
        keys, reps = [], []
        for k, (shingles, _) in enumerate(shingle_hashes(texts.to_pylist(), words)):
            keys.append(first_shingles_of(shingles, percent, frequent, counts))
            reps.append(np.full(len(keys[-1]), of[k]))
        brought = np.unique(np.stack([np.concatenate(keys).view(np.int64), np.concatenate(reps)], axis=1), axis=0)
        pairs = np.concatenate(linked_pairs)
        key = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(brought[:, 0])])
        root = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(brought), pa.int64())])
        return pa.table({"key": key, "rep": np.concatenate([pairs[:, 0], brought[:, 1]]), "root": root})

    return run


def _parted(large: DataFrame, words: int, percent: int, first_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(rep, part) of the texts in ``large`` (group, rep, n, k, text) that some other may be linked with, and the links (node, root) that were found on the way."""
    place = F.pmod(F.xxhash64("rep"), F.col("k") * COUNTED)
    lists = written(large.filter(place == 0).groupBy("group").applyInArrow(_frequent(words), "group long, k long, frequent array<long>, counts array<long>"), "frequent")
    blocks = lists.select("group", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("i"), "frequent", "counts")
    dealt = large.select("group", _dealt(large, "rep", F.col("k")).alias("i"), "rep", "n", "text")
    found = dealt.groupBy("group", "i").cogroup(blocks.groupBy("group", "i")).applyInArrow(_firsts(words, percent, first_shingles), FIRSTS)
    found = written(found, "firsts")
    links = found.filter("key is null").select(F.col("rep").alias("node"), "root")
    keyed = found.filter("key is not null").select("key", "rep", _dealt(found, "rep", F.lit(PARTS)).alias("part"))
    each = keyed.groupBy("key", "part").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"))
    leads = each.groupBy("key").agg(F.min("lead").alias("lead"), F.max("last").alias("last"), F.collect_list("part").alias("parts")).filter("lead < last")  # PARTS at most
    stars = keyed.join(leads.select("key", F.explode("parts").alias("part"), "lead"), ["key", "part"]).filter("rep <> lead").select("rep", "lead").distinct()
    most = found.count()
    parts = connected_components(stars.union(links), "rep", "lead", most_edges=most)
    return written(parts.select(F.col("node").alias("rep"), F.col("root").alias("part")).union(parts.select("root", "root").distinct()), "parts", 2 * most), links


def _large_links(large: DataFrame, first: DataFrame, verify, block: int) -> DataFrame:
    """(node, root) of the groups that fill several blocks: ``large`` has group, rep, n and text, ``first`` the links within first blocks."""
    links, texts = first, large.count()
    for both in (False, True):
        found = connected_components(links, "node", "root", most_edges=links.count()).withColumnRenamed("root", "label")
        members = large.select("group", "rep", "n").distinct().join(found, F.col("rep") == F.col("node"), "left").select("group", "rep", "n", F.coalesce("label", "rep").alias("label"))
        members = written(members, "labels", texts)
        if not both:  # the smallest of each component by now
            meet = members.filter("rep = label")
            totals = small(meet.groupBy("group").agg(F.ceil(F.sum("n") / block).alias("k")))
            units = meet.join(totals, "group").select("rep", "group", _dealt(meet, "rep", F.col("k")).alias("i"), F.lit(0).alias("j"), "label")
        else:
            by_label = written(members.groupBy("group", "label").agg(F.sum("n").alias("n")), "components", texts)
            open_groups = by_label.groupBy("group").agg(F.count("*").alias("c"), F.ceil(F.sum(F.when(F.col("n") < block, F.col("n"))) / block).alias("mixed")).filter("c > 1")
            own = by_label.filter(F.col("n") >= block).withColumn("k", F.ceil(F.col("n") / block))
            before = Window.partitionBy("group").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
            own = own.select("group", "label", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("from"))  # a row for each full block at most
            wide = own.groupBy("group").agg(F.sum("k").alias("own"))
            totals = small(open_groups.join(wide, "group", "left").select("group", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("mixed", F.lit(0)).alias("mixed")))
            placed = members.join(totals, "group").join(small(own), ["group", "label"], "left")
            # blocks of one component are not compared with one another
            last = F.col("own") + F.col("mixed") - 1
            upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
            mine = F.when(F.col("k").isNull(), F.col("own") + _dealt(members, "rep", F.greatest("mixed", F.lit(1)))).otherwise(F.col("from") + _dealt(members, "rep", F.col("k")))
            others = F.when(F.col("k").isNull(), upto(F.lit(0).cast("long"), last)).otherwise(F.concat(upto(F.lit(0).cast("long"), F.col("from") - 1), upto(F.col("from") + F.col("k"), last)))
            met = placed.select("rep", "group", "label", mine.cast("long").alias("mine"), F.explode(others).alias("other"))
            units = met.select("rep", "group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "label")
        gathered = units.join(large.select("rep", "text"), "rep")
        more = gathered.groupBy("group", "i", "j").applyInArrow(verify, LINKS)
        links = written(links.union(more), "links")
    return connected_components(links, "node", "root", most_edges=links.count())


def near_groups(docs: DataFrame, percent: int = 80, words: int = 5, bands: int = 64, rows_per_band: int = 8, block_shingles: int = 1_000_000, first_shingles: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text", ids_repeat: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest identifier reachable by links) and kept.

    Documents are linked when 100 * shared shingles >= ``percent`` * shingles of both together. A block that
    is verified in one task holds about ``first_shingles`` shingles at first, in large groups 16 such, and where blocks of
    a part of them are compared about ``block_shingles``, or two such. ``ids_repeat=False`` says that no two rows share an identifier.
    """
    texts = slim(docs, id_col, text_col)
    every = written(sketches(texts, words, bands, rows_per_band), "sketches")
    some = every.filter("n_shingles > 0")
    many, shingles = some.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()  # texts are written, and verified, by so many shingles a task
    classes = written(some.filter("doc_id is not null").groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes", many * bands)

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("key", "lead")
    stars = keyed.join(buckets, "key").filter("rep <> lead").select("rep", "lead")
    proposed = connected_components(stars, "rep", "lead", most_edges=many * bands)

    members = proposed.select(F.col("root").alias("group"), F.col("node").alias("rep")).union(proposed.select("root", "root").distinct())
    members = written(members.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n")), "rep"), "members", many)
    totals = members.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    large = small(totals.filter((F.col("n") > first_shingles) & (F.col("c") > 1)).select("group", F.ceil(F.col("n") / (WIDE * first_shingles)).alias("k")))
    dealt = members.join(large, "group", "left").select("group", "rep", "n", "k")
    # a merge join at every size: the texts always outgrow what may be broadcast, and so does the other side
    gathered = written(dealt.hint("merge").join(texts, F.col("rep") == F.col("doc_id")).select("group", "rep", "n", "k", "text").distinct(), "gathered", shingles)

    verify = _verified(words, percent)
    whole = written(gathered.filter("k is null").select("group", "rep", F.col("rep").alias("label"), "text").groupBy("group").applyInArrow(verify, LINKS), "links", shingles)
    several = gathered.filter("k is not null")
    if not several.isEmpty():
        parts, links = _parted(several, words, percent, first_shingles)
        whole = whole.union(_large_links(several.select("rep", "n", "text").join(small(parts), "rep").withColumnRenamed("part", "group"), links, verify, block_shingles))
    # an identifier with several sets links their classes, also where it stands for neither
    repeated = some.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("high", "low", "n_shingles")).alias("a"), F.max(F.struct("high", "low", "n_shingles")).alias("b")).filter("a <> b").select("doc_id")
    if ids_repeat and not repeated.isEmpty():
        ids = some.join(repeated, "doc_id").select("doc_id", "high", "low", "n_shingles").distinct()
        shared = written(ids.join(classes, ["high", "low", "n_shingles"]).select("doc_id", "rep"), "shared")
        least = shared.groupBy("doc_id").agg(F.min("rep").alias("root"))
        whole = connected_components(whole.union(shared.join(least, "doc_id").filter("rep <> root").select(F.col("rep").alias("node"), "root")), "node", "root").select(F.col("node"), F.col("root"))
    roots = classes.join(whole.groupBy("node").agg(F.min("root").alias("root")), F.col("rep") == F.col("node"), "left").select("high", "low", "n_shingles", F.coalesce("root", "rep").alias("root"))
    # texts without words are one set, but no group: they stay out of the join
    found = some.join(roots, ["high", "low", "n_shingles"], "left").select("doc_id", "n_shingles", "root").union(every.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root")))
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, **how: object) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all columns: that of the smallest identifier (null is the largest), and of several such rows the first as they were written. Rows without words stay."""
    each = numbered(docs)
    found = near_groups(each, id_col=ROW, ids_repeat=False, **how).select(F.col("doc_id").alias(ROW), "component_id")
    first = found.join(each.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    return each.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)
