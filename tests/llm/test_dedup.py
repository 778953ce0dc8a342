"""Exact and near duplicates against brute force, with skewed groups and every defined case."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import components, exact_dedup, near_dedup
from millrace.llm.common import written
from millrace.llm.components import connected_components
from millrace.llm.patricia import PatriciaTrie
from millrace.llm.shingles import exact_sets, shingle_hashes, sketch

SF = Path("/root/testdata/sf0.001")


def words_of(text):
    return (text or "").encode().lower().split()


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = words_of(t)
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def messy(n=150, seed=1):
    """Copies, near copies, passages, short, empty and null texts."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(1, 4)))
    base = [" ".join(word() for _ in range(random.randint(1, 120))) for _ in range(20)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "One two"), (4, "one  TWO"), (5, "x " * 30_000)]
    while len(rows) < n:
        t = random.choice(base).split(" ")
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            t[random.randrange(len(t))] = word()
        t = " ".join(t)
        rows.append((len(rows) * 7 % 1009, random.choice([t, t.upper(), t.replace(" ", "\t"), t + " "])))
    return list(dict(rows).items())


@pytest.mark.parametrize("limit", [1, 500, 5_000, 1 << 20])
@pytest.mark.parametrize("choose", [min, max])
def test_trie_holds_all_groups_however_much_it_spills(limit, choose):
    random.seed(limit)
    texts = [bytes(random.choices(b"ab", k=random.randint(0, 12))) * random.choice([1, 30]) for _ in range(2000)]
    trie, want = PatriciaTrie(choose, limit), {}
    for k, t in enumerate(texts):
        owner = None if k % 10 == 0 else k
        trie.insert(t, owner)
        o, n = want.get(t, (None, 0))
        want[t] = (owner if o is None else o if owner is None else choose(o, owner), n + 1)
    got = list(trie.groups())
    assert len(got) == len(want) and {t: (o, n) for t, o, n in got} == want


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    rows = [*messy(), (None, "one  TWO"), (None, "alone"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, text_sha256 string, n_bytes int").repartition(5)
    got = exact_dedup.exact_groups(df, keep=keep, trie_bytes=4_000).collect()
    groups = defaultdict(list)
    lower = lambda t: (t or "").encode().lower()
    for i, t in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        owner = (min if keep == "min" else max)(ids) if ids else None
        want.append((i, owner, len(groups[lower(t)]), i == owner))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert exact_dedup.drop_copies(df, keep).columns == df.columns


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 300)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for e in edges for n in e if find(n) != n}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == want


@pytest.fixture
def files(spark, monkeypatch):
    """Files of each table that is written between the steps, where shuffles leave many small partitions."""
    found, held = [], {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}

    def counted(df, name, *most):
        out = written(df, name, *most)
        found.append((name, len(out.inputFiles())))
        return out

    for module in (components, near_dedup):
        monkeypatch.setattr(module, "written", counted)
    for k, v in held.items():
        spark.conf.set(k, v)
    yield found
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rounds_of_a_small_graph_are_few_files(spark, files):
    edges = [(k, k + 1) for k in range(0, 900, 3)] + [(k + 1, k + 2) for k in range(0, 900, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {k: k - k % 3 for k in range(900) if k % 3}
    assert len(files) > 1 and all(n <= 16 for _, n in files[1:])


def test_near_copies_of_few_texts_are_few_files(spark, files):
    rows = [(200 * j + k, " ".join(f"w{j}x{i}" for i in range(60)) + f" {k}") for j in range(40) for k in range(3)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), first_shingles=100).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 200 for i, _ in rows}
    assert {"classes", "gathered", "links", "parts", "labels"} <= {name for name, _ in files}
    assert all(n <= 16 for name, n in files if name in ("edges", "classes", "members", "gathered", "parts", "labels"))


def test_shingles_are_those_of_the_words():
    texts = [(t or "").encode() for _, t in messy()]
    want = list(brute_sets(list(enumerate(t.decode() for t in texts))).values())
    hashed, exact = [x for x, _ in shingle_hashes(texts)], exact_sets(texts)
    for got in (hashed, exact):
        assert [len(x) for x in got] == [len(x) for x in want]
        for a in range(0, len(texts), 7):
            for b in range(a):
                assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])
    assert [len(x) for x in exact_sets([b"a b c", b"a b c d e f g", b""], words=3)] == [1, 5, 0] and exact_sets([]) == []


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_alike_to_polynomials_modulo_a_power_of_two(spark):
    one, other = thue_morse(11)
    texts = [" ".join([one] * 5 + [other] * 5), " ".join([one] * 10), " ".join([other] * 10)]
    assert [len(x) for x in exact_sets([t.encode() for t in texts])] == [6, 1, 1]
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=50).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 6, 0), (1, 1, 1), (2, 1, 2)]


def test_sketches_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        agree = []
        for _ in range(60):
            a = rng.integers(0, 2**63, n * 2, dtype=np.uint64)
            x, y = sketch(np.unique(a[:n]), 150), sketch(np.unique(a[n // 3 : n + n // 3]), 150)
            assert x.max() < np.iinfo(np.uint64).max
            agree.append((x == y).mean())
        shared, union = n - n // 3, n + n // 3
        assert abs(np.mean(agree) - shared / union) < 0.04


@pytest.mark.parametrize(("percent", "block"), [(85, 1_000_000), (80, 60), (60, 300)])
def test_near_groups(spark, percent, block):
    rows = messy(220, percent)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, rep int, key string").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_groups(df, percent=percent, block_shingles=4 * block, first_shingles=block, rows_per_band=5 if percent > 70 else 2, bands=30 if percent > 70 else 60).collect()}
    sets = brute_sets(rows)
    want = brute_components(sets, percent)
    assert len(got) == len(rows)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted([tuple(r) for r in near_dedup.near_groups(df).collect()], key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert near_dedup.near_groups(df.limit(0)).count() == 0
    assert near_dedup.drop_near_copies(df).columns == df.columns


def test_an_identifier_with_two_texts_links_their_classes(spark):
    a, b, c = "a b c d e f g", "one two three four five six", "an other text of many words here"
    rows = [(1, a), (5, a), (5, b), (9, b), (20, c), (9, c), (7, "alone with five words here"), (7, None), (3, "quite an other one of these")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect())
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 1, False), (9, 1, False), (9, 1, False), (20, 1, False), (7, 7, True), (7, 7, True), (3, 3, True)])


def test_a_chain_of_edits_is_one_component(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):  # each step changes one word; the ends have little in common
        rows.append((k, " ".join(words)))
        words[(k * 5) % 200] = f"n{k}"
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=90, first_shingles=900, block_shingles=2000)
    assert {r.component_id for r in got.collect()} == {0}


def test_groups_of_several_blocks_keep_every_link(spark):
    """Texts that are candidates of one another, a part of them linked in long chains, over many small blocks."""
    random.seed(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for chain in range(6):
        words = base[:90] + [f"c{chain}-{k}" for k in range(60)]
        for k in range(25):
            rows.append((len(rows) * 37 % 1009, " ".join(words)))
            words[90 + (k * 7) % 60] = f"n{chain}-{k}"
    sets = brute_sets(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(sets, 88)
    for first, block in ((300, 700), (1000, 100_000)):
        got = near_dedup.near_groups(df, percent=88, bands=60, rows_per_band=2, first_shingles=first, block_shingles=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) >= 6


def test_copies_of_one_original_that_are_not_alike(spark):
    """Each copy is like the original, no two copies are like one another; the original has neither the first nor the last identifier."""
    random.seed(6)
    base = [f"w{k}" for k in range(300)]
    rows = [(500, " ".join(base))]
    for k in range(120):
        words = list(base)
        at = random.randrange(0, 270)
        words[at : at + 24] = [f"e{k}-{j}" for j in range(24)]
        rows.append((k if k < 60 else 1000 + k, " ".join(words)))
    sets = brute_sets(rows)
    want = brute_components(sets, 80)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=80, first_shingles=3000, block_shingles=6000).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 1


def test_dropped_copies_keep_all_columns_whatever_their_names(spark):
    rows = [(1, "a b c d e f", 1, "x", None), (2, "A b c d e f", 2, "y", 0.5), (3, "other words here", 3, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, component_id string, `rep` double")
    assert [tuple(r) for r in exact_dedup.drop_copies(df, "max").orderBy("doc_id").collect()] == rows[1:]
    assert [tuple(r) for r in near_dedup.drop_near_copies(df).orderBy("doc_id").collect()] == [rows[0], rows[2]]


def test_one_word_of_many_megabytes(spark):
    rows = [(1, "x" * 3_000_000), (2, "X" * 3_000_000), (3, "y" * 3_000_000), (4, "a b c d e f " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.near_groups(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 6, 4, True)]
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_near_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = brute_sets([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, percent=85).collect()}
    assert got == brute_components(sets, 85)


def with_a_passage(n=160, seed=7):
    """Texts of which two thirds are one passage, so that all are candidates of one another, and a few near copies among them."""
    random.seed(seed)
    passage = [f"p{k}" for k in range(100)]
    rows, last = [], []
    for k in range(n):
        words = [*passage, *(f"o{k}-{j}" for j in range(50))] if k % 8 else last
        if not k % 8 and words:
            words = list(words)
            words[-1] = f"x{k}"
        last = words or [*passage, "first"]
        rows.append((k * 37 % 1009, " ".join(last)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_a_common_passage_makes_no_block(spark, monkeypatch, percent):
    rows = with_a_passage()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = []
    plain = near_dedup._large_links
    monkeypatch.setattr(near_dedup, "_large_links", lambda large, *a: (met.append(large.groupBy("group").count().collect()), plain(large, *a))[1])
    got = near_dedup.near_groups(df, percent=percent, first_shingles=1_000, block_shingles=4_000).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(brute_sets(rows), percent)
    # all texts were one group of candidates, of which only those with near copies meet again, by their own few
    assert len(met) == 1 and met[0] and max(r["count"] for r in met[0]) <= 3 and sum(r["count"] for r in met[0]) < len(rows) // 3


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_share_a_first_shingle_in_any_order(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)]))
        frequent = np.sort(rng.permutation(np.union1d(a, b))[: rng.integers(0, 30)])
        counts = rng.integers(2, 5, len(frequent))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= percent * (len(a) + len(b) - common):
            first = [near_dedup.first_shingles_of(x, percent, frequent, counts) for x in (a, b)]
            assert len(np.intersect1d(*first))
