"""Language model, toxicity and language identification."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import class_lm, langid, toxicity
from millrace.llm.common import slim, written

SF = Path("/root/testdata/sf0.01")
fold = lambda i, m: zlib.crc32(b"" if i is None else str(i).encode()) % m


def sentences(n=300, seed=2):
    random.seed(seed)
    kinds = [["the", "a", "this"], ["dog", "cat", "bird", "fish"], ["eats", "sees", "hears"]]
    return [" ".join(random.choice(kinds[k % 3]) for k in range(random.randint(0, 30))).upper() for _ in range(n)]


def test_class_scores(spark):
    rows = [*enumerate(sentences()), (1000, None), (1001, ""), (None, "the dog"), (1002, "zzz unseen dog\tthe"), (1003, "the " * 5000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = class_lm.class_scores(df, head=6, clustered=5, classes=3, rounds=4).collect()
    assert len(got) == len(rows)
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0 and r.perplexity > 1
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution(spark):
    df = slim(spark.createDataFrame(list(enumerate(sentences())), "doc_id long, text string"))
    counts = written(class_lm.word_counts(df), "words")
    m = class_lm.fit(df, df.count(), counts, head=8, clustered=6, classes=3, rounds=6)
    assert np.allclose((10**m.transitions).sum(axis=1), 1)
    for c in range(3):
        own = m.emissions[m.classes == c]
        assert not len(own) or (10**own).sum() == pytest.approx(1)
    known = {r.word: r.n for r in counts.collect()}
    shared = [n for w, n in known.items() if bytes(w) not in m.vocabulary.words[: len(m.classes)]]
    # one more place is kept for all unseen words
    assert sum(n + 1 for n in shared) + 1 == pytest.approx(10**m.shared_total)


def test_exchange_finds_the_kinds(spark):
    df = slim(spark.createDataFrame(list(enumerate(sentences(600))), "doc_id long, text string"))
    m = class_lm.fit(df, 600, written(class_lm.word_counts(df), "words"), head=50, clustered=50, classes=3, rounds=12)
    kind = dict(zip([w.decode() for w in m.vocabulary.words], m.classes.tolist(), strict=False))
    assert len({kind[w] for w in ("the", "a", "this")}) == 1 and len({kind[w] for w in ("dog", "cat", "bird", "fish")}) == 1


def test_best_moves_agree_with_brute_force():
    rng = np.random.default_rng(0)
    m, c = 8, 3
    pairs = rng.integers(0, 20, (m, m))
    own = np.arange(m) % c
    table = np.zeros((c, c))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    right = np.stack([[pairs[w, own == g].sum() for g in range(c)] for w in range(m)]).astype(float)
    left = np.stack([[pairs[own == g, w].sum() for g in range(c)] for w in range(m)]).astype(float)

    def value(classes):
        t = np.zeros((c, c))
        np.add.at(t, (classes[:, None], classes[None, :]), pairs)
        x = class_lm._xlogx
        return x(t).sum() - x(t.sum(1)).sum() - x(t.sum(0)).sum()

    to, gain = class_lm.best_moves(own, right, left, np.diag(pairs).astype(float), table, c)
    for w in range(m):
        options = []
        for h in range(c):
            other = own.copy()
            other[w] = h
            options.append(value(other))
        assert options[to[w]] == pytest.approx(max(options)) and gain[w] == pytest.approx(max(options) - value(own), abs=1e-6)


def test_best_classes_agree_with_brute_force():
    rng = np.random.default_rng(1)
    m, c = 9, 3
    pairs = rng.integers(0, 6, (m, m))
    own = np.append(np.arange(6) % c, [c, c, c])  # three words in the shared class
    ends = np.eye(c + 1)[own]
    sides = np.stack([pairs @ ends, pairs.T @ ends], axis=1).astype(float)

    def table(classes):
        t = np.zeros((c + 1, c + 1))
        np.add.at(t, (classes[:, None], classes[None, :]), pairs)
        return t

    def value(t):
        x = class_lm._xlogx
        return x(t).sum() - x(t.sum(1)).sum() - x(t.sum(0)).sum()

    got = class_lm.best_classes(sides[6:], np.diag(pairs)[6:].astype(float), table(own), c)
    for w, to in zip(range(6, m), got, strict=True):
        options = []
        for h in range(c):
            other = own.copy()
            other[w] = h
            options.append(value(table(other)))
        assert options[to] == pytest.approx(max(options))


def test_words_beyond_the_clustered_get_their_class(spark):
    texts = [(i, t.lower()) for i, t in enumerate(sentences(600))] + [(700, "the wolf eats a dog sees the wolf hears"), (701, "a lynx hears")]
    df = slim(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    m = class_lm.fit(df, len(texts), written(class_lm.word_counts(df), "words"), head=10, clustered=8, classes=3, rounds=12)
    words = class_lm.placed(df, m).collect()
    kind = {**dict(zip((w.decode() for w in m.vocabulary.words), m.classes.tolist(), strict=False)), **{(m.vocabulary.words[r.id] if r.id >= 0 else bytes(r.word)).decode(): r["class"] for r in words}}
    counts = Counter(w for _, t in texts for w in t.split())
    assert set(kind) == set(counts)
    assert all(r.n == counts[(m.vocabulary.words[r.id] if r.id >= 0 else bytes(r.word)).decode()] for r in words)
    assert kind["wolf"] == kind["lynx"] == kind["dog"] and kind["dog"] != kind["eats"]


def test_words_of_equal_count_are_not_left_out_together(spark):
    texts = [(i, f"w{i:02d} end") for i in range(60)]
    df = slim(spark.createDataFrame(texts, "doc_id long, text string"))
    counts = written(class_lm.word_counts(df), "words")
    for head in (1, 30, 60, 61, 100):
        v = class_lm.vocabulary_of(counts, 60, head)
        assert v.words == (b"end", *(f"w{i:02d}".encode() for i in range(60)))[:head]
        assert (v.tokens, v.types, v.counts.tolist()) == (180, 62, ([60] + [1] * 60)[:head])
    m = class_lm.fit(df, 60, counts, head=40, clustered=20, classes=4)
    assert len(m.classes) == 20 and class_lm.placed(df, m).count() == 61 - 20


def scored_plainly(rows, kind, classes, prior):
    """The model's score of each text from each word's class, one word and one sum at a time."""
    tokens = {i: (t or "").lower().split() for i, t in rows}
    training = [i for i, _ in rows if fold(i, 7) != 2]
    counts = Counter(w for i in training for w in tokens[i])
    unseen, end = classes, classes + 1
    sides = lambda w: [end] if w is None else [unseen] if w not in counts else [kind[w], unseen] if counts[w] == 1 else [kind[w]]
    table = np.zeros((classes + 2, classes + 2))
    for i in training:
        line = [None, *tokens[i], None]
        for a, b in zip(line, line[1:], strict=False):
            # a word seen once is itself in one half and the unseen word in the other, the same half for its neighbours
            for half in (0, 1):
                table[sides(a)[half % len(sides(a))], sides(b)[half % len(sides(b))]] += 0.5
    size = table.sum(axis=0)
    unigram = (size + 0.5) / (size + 0.5).sum()
    out = {}
    for i, _ in rows:
        at, score = end, 0.0
        for w in [*tokens[i], None]:
            to = sides(w)[0]
            score += math.log10((table[at, to] + prior * unigram[to]) / (table[at].sum() + prior))
            if w in counts:
                score += math.log10((0.5 if counts[w] == 1 else counts[w]) / size[to])
            at = to
        out[i] = score
    return out


def test_scores_agree_with_plain_sums(spark):
    random.seed(11)
    rows = [(i, t + random.choice(["", " once%d" % i, " rare%d" % (i // 2)])) for i, t in enumerate(sentences(250))] + [(900, None), (901, "new words the dog"), (902, "dog\ndog dog")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = {"head": 12, "clustered": 8, "classes": 4, "rounds": 6}
    got = {r.doc_id: r for r in class_lm.class_scores(df, **how).collect()}
    training = slim(df.filter(df.doc_id.isin([i for i, _ in rows if fold(i, 7) != 2])))
    m = class_lm.fit(training, training.count(), written(class_lm.word_counts(training), "words"), **how)
    kind = dict(zip((w.decode() for w in m.vocabulary.words), m.classes.tolist(), strict=False))
    kind |= {(m.vocabulary.words[r.id] if r.id >= 0 else bytes(r.word)).decode(): r["class"] for r in class_lm.placed(training, m).collect()}
    want = scored_plainly(rows, kind, 4, 20.0)
    for i, r in got.items():
        assert r.score == pytest.approx(want[i], abs=1e-6), i
        assert r.perplexity == pytest.approx(10 ** (-want[i] / r.n_tokens))


def test_repeated_rows_count_and_score_each(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b"), (None, "c c"), (None, "c c")]
    got = class_lm.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = sum(len(t.split()) + 1 for i, t in rows if fold(i, 7) != 2)
    assert len(got) == 5 and {r.train_tokens for r in got} == {n}
    assert len({(r.doc_id, r.score) for r in got}) == 3


def test_exchange_goes_on_until_it_gains_nothing(spark):
    df = slim(spark.createDataFrame(list(enumerate(sentences(600))), "doc_id long, text string"))
    pairs = written(class_lm.bigrams(df, tuple(w.encode() for w in ("the", "a", "this", "dog", "cat", "bird", "fish", "eats", "sees", "hears"))), "pairs")
    few, many = (class_lm.exchange(pairs, 10, 3, rounds)[0] for rounds in (1, 12))
    assert len(set(zip(few.tolist(), many.tolist(), strict=True))) == 3


def test_class_scores_without_training(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert class_lm.class_scores(df).count() == 0
    only_held = next(i for i in range(100) if fold(i, 7) == 2)
    r = class_lm.class_scores(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)


def toxic_docs(n=400, seed=6):
    random.seed(seed)
    plain = ["house", "river", "green", "walks", "table", "sings", "under", "about"]
    docs, labels = [], []
    for i in range(n):
        parts = [" ".join(random.choices(plain, k=random.randint(2, 9))) for _ in range(random.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            k = random.randrange(len(parts))
            parts[k] += random.choice([" vermin", " VERMINOUS,", " swine"])
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    docs, labels = toxic_docs()
    odd = [(900, None), (901, ""), (902, "!!!"), (None, "river swine"), (903, "house. " * 5000), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in [*docs, *odd]], "doc_id long, text string, toxic int").repartition(3)
    lab = spark.createDataFrame([*labels, (0, 0), (None, 1), (17, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab, least_documents=2)
    got = toxicity.toxicity(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    text = dict(docs)
    for r in got:
        if r.doc_id in truth and truth[r.doc_id]:
            assert any("ver" in text[r.doc_id][s.start : s.end].lower() or "swine" in text[r.doc_id][s.start : s.end] for s in r.offending)
    assert next(r for r in got if r.doc_id == 903).predicted == 0


def noisy_or_plainly(text, model, threshold):
    """Score, number of sentences and the sentences that reach the threshold, from the weights alone."""
    parts, now = [], ""
    for c in text or "":
        if c in ".!?\n":
            parts.append(now)
            now = ""
        else:
            now += c
    miss, n, found = 1.0, 0, []
    for sentence in [*parts, now]:
        n += bool(sentence.split())
        known = [model.weights[f] for w in sentence.lower().split() for f in toxicity.word_features(w) if f in model.weights]
        if known:
            p = 1 / (1 + math.exp(-model.bias - sum(known)))
            miss *= 1 - p
            if p >= threshold:
                found.append(sentence)
    return 1 - miss, n, found


def test_noisy_or_agrees_with_plain_products(spark):
    docs, labels = toxic_docs()
    odd = [(900, None), (901, ""), (902, "?!.\n"), (903, "swine. " * 3), (904, "swine\nvermin! house?Swine. "), (905, "«swine» house"), (905, "«swine» house")]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string").repartition(3)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), least_documents=2)
    got = toxicity.toxicity(df, model).collect()
    text = dict([*docs, *odd])
    for r in got:
        score, n, found = noisy_or_plainly(text[r.doc_id], model, 0.3)
        assert r.score == pytest.approx(score, abs=1e-9) and r.n_sentences == n
        assert [text[r.doc_id][x.start : x.end] for x in r.offending] == found
    assert next(r for r in got if r.doc_id == 903).n_sentences == 3 and len(got) == len(docs) + len(odd)


def test_known_words_that_cancel_out_are_evidence():
    model = toxicity.Model({"up$": 2.0, "down$": -2.0}, -1.0)
    score, n, _ = toxicity.scorer(model, 0.3)([b"up down. else"])[0]
    assert score == pytest.approx(1 / (1 + math.e)) and n == 2


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (20_000 if i % 10 == 0 else 40)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, 100_000, 16_000).collect()
    for label in (0, 1):
        own = [r for r in got if r.toxic == label]
        assert 8_000 < sum(len(r.text) for r in own) < 24_000 and max(len(r.text) for r in own) <= 1000 and all(fold(r.doc_id, 4) != 2 for r in own)
        assert sum(r.weight for r in own) == pytest.approx(sum(i % 2 == label and fold(i, 4) != 2 for i in range(400)))
    assert len(toxicity.training_rows(docs, labels, 100_000, 1 << 30).collect()) == sum(fold(i, 4) != 2 for i in range(400))


def test_toxicity_without_examples(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(df, toxicity.fit(df, none)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), toxicity.Model({}, -np.inf)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def language_plainly(text, model, penalty):
    """The chosen languages' shares and the score, one word and one step at a time."""
    logs = []
    for word in (text or "").lower().split():
        word = word.strip(langid._EDGE)
        if any(c.isalpha() for c in word):
            raw, total = f" {word} ".encode(), np.zeros(len(model.languages))
            for n, table in zip(langid.GRAMS, model.tables, strict=True):
                for k in range(len(raw) - n + 1):
                    key = (int.from_bytes(raw[k : k + n], "big") + n) * 0x9E3779B97F4A7C15 % 2**64 >> 48
                    total += table[key].astype(float)
            logs.append(total / len(langid.GRAMS))
    if not logs:
        return {}, 0.0, "und"
    p = np.exp([x - x.max() for x in logs])

    def mixture(among):
        share = np.array([1 / len(among) if k in among else 0.0 for k in range(len(model.languages))])
        for _ in range(12):
            r = p * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, float(np.log((p * share).sum(axis=1)).sum())

    every, _ = mixture(set(range(len(model.languages))))
    order = sorted(range(len(model.languages)), key=lambda k: -every[k])
    first = int(np.log(p).sum(axis=0).argmax())
    chosen, best = np.eye(len(model.languages))[first], float(np.log(p).sum(axis=0)[first])
    for size in range(2, len(order) + 1):
        share, value = mixture(set(order[:size]))
        if value - best <= penalty * math.log(max(len(logs), 2)):
            break
        chosen, best = share, value
    return {model.languages[k]: x for k, x in enumerate(chosen) if x > 0}, float(every[chosen.argmax()]), model.languages[int(chosen.argmax())]


def test_mixtures_agree_with_plain_steps(spark):
    tongues = {"en": "the house and the river were under the green tree", "de": "der hund und die katze sind unter dem tisch", "fr": "la maison et le fleuve sont sous les arbres verts"}
    random.seed(8)
    some = lambda lang, n: " ".join(random.choices(tongues[lang].split(), k=n))
    rows = [(i, some(lang, 12), lang) for i in range(90) for lang in [list(tongues)[i % 3]]]
    rows += [(200 + i, some("en", random.randint(0, 20)) + " " + some("de", random.randint(0, 20)) + " " + some("fr", random.randint(0, 6)) + " 12 «Haus» x", None) for i in range(60)]
    rows += [(300, None, "en"), (301, "7 ! 8", None), (302, "same", None), (302, "same", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df)
    text = {i: t for i, t, _ in rows}
    got = langid.identify(df, model).collect()
    several = 0
    for r in got:
        shares, score, lang = language_plainly(text[r.doc_id], model, 2.0)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
        assert {x.lang: x.share for x in r.languages} == pytest.approx(shares, abs=1e-4)
        several += len(shares) > 1
    assert several > 10 and len(got) == len(rows)


def test_tables_are_the_counts_of_the_training_rows(spark):
    rows = [(i, "ab ab, cd" if i % 2 else "xy", "b" if i % 2 else "a") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = [r for r in rows if fold(r[0], 4) != 2]
    n_a, n_b = sum(r[2] == "a" for r in own), sum(r[2] == "b" for r in own)
    # bigrams of " xy ": 3; of " ab " twice and " cd ": 9
    for lang, total, most in ((0, 3 * n_a, n_a), (1, 9 * n_b, 2 * n_b)):
        share = np.exp(model.tables[0][:, lang].astype(float))
        assert share.sum() == pytest.approx(1, abs=1e-3)
        assert share.max() == pytest.approx((most + 0.5) / (total + 0.5 * langid.BUCKETS), rel=1e-3)


def many_languages(n, seed=2):
    """Words of ``n`` made-up languages, each of its own letters and endings."""
    random.seed(seed)
    return {f"x{k:03}": ["".join(random.choices("abcdefghijklmnopqrstuvwxyzäöüñéß", k=random.randint(2, 7))) + random.choice("aeiou") for _ in range(60)] for k in range(n)}


def test_all_of_150_languages_are_learned(spark):
    tongues = many_languages(150)
    rows = [(i, " ".join(random.choices(words, k=40)), lang) for i, (lang, words) in enumerate((x for x in tongues.items() for _ in range(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, table_bytes=16 << 20)
    assert model.languages == tuple(tongues) and model.buckets == 8192
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    held = [(i, lang) for i, _, lang in rows if fold(i, 4) == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)


@pytest.mark.parametrize("languages", [3, 30])
def test_long_texts_by_parts_are_as_by_whole(languages, monkeypatch):
    tongues, rng = many_languages(languages), np.random.default_rng(3)
    tables = tuple(np.log(rng.dirichlet(np.full(1024, 0.3), languages).T + 1e-6).astype(np.float32) for _ in langid.GRAMS)
    model, words = langid.Model(tuple(tongues), tables), list(tongues.values())
    texts = [" ".join(random.choice(words[k % languages] + words[(k + 1) % languages]) for _ in range(k * 30)).encode() for k in range(30)] + [b"", b"1 2 3 " * 50, "\n ".encode() * 100]
    whole = langid.predictor(model)(texts)
    monkeypatch.setattr(langid, "PART", 7)
    monkeypatch.setattr(langid, "CHUNK", 40)
    parts = langid.predictor(model)(texts)
    assert parts[0] == whole[0] and parts[1] == pytest.approx(whole[1], abs=1e-5)
    assert [{x["lang"]: x["share"] for x in d} for d in parts[2]] == [pytest.approx({x["lang"]: x["share"] for x in d}, abs=1e-5) for d in whole[2]]


def test_a_text_of_20_mb_in_100_languages_takes_less_than_a_gigabyte():
    import subprocess
    import sys

    run = """
import resource, sys
import numpy as np
from millrace.llm import langid
rng = np.random.default_rng(1)
model = langid.Model(tuple(f"x{k:03}" for k in range(100)), tuple(np.log(rng.dirichlet(np.full(65536, 0.1), 100).T + 1e-7).astype(np.float32) for _ in langid.GRAMS))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(int(sys.argv[1]))]
text = " ".join(words[k] for k in rng.integers(0, len(words), 2_300_000)).encode()
print(len(text), *langid.predictor(model)([text])[:2], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    for distinct in ("2000", "300000"):
        size, *_, most = subprocess.run([sys.executable, "-c", run, distinct], capture_output=True, text=True, check=True, cwd=str(Path(__file__).resolve().parents[2])).stdout.split()
        assert int(size) > 20_000_000 and float(most) < 1000


def test_of_equal_languages_the_first_by_name(spark):
    rows = [(i, "same words here", "zz" if i % 2 else "aa") for i in range(40)]
    rows = [r for r in rows if fold(r[0], 4) != 2]
    n = min(sum(r[2] == x for r in rows) for x in ("aa", "zz"))
    even = [r for x in ("aa", "zz") for r in [y for y in rows if y[2] == x][:n]]
    df = spark.createDataFrame(even, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()} == {"aa"}


def test_language_cases(spark):
    en, de = "the house and the river were under the green tree ", "der hund und die katze sind unter dem tisch "
    rows = [(i, random.choice([en, en.upper()]) if i % 2 else de, "en" if i % 2 else "de") for i in range(80)]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !!! \n", "en"), (903, en * 30 + de * 30, None), (904, de * 2000, None), (None, en, "en"), (905, "ß", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in [*rows, *odd]], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and {got[i].score for i in (900, 901, 902)} == {0.0}
    assert got[904].lang_pred == "de" and got[None].lang_pred == "en" and got[905].lang_pred in ("de", "en")
    assert {x.lang for x in got[903].languages} == {"de", "en"} and 0.3 < got[903].score < 0.7
    assert all(r.lang_pred == ("en" if i % 2 else "de") for i, r in got.items() if i is not None and i < 80)
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0


def test_fitted_weights_are_where_the_loss_is_flat(spark):
    """The loss by plain sums over sentences, and its slope by differences, at the fitted weights and at their start."""
    random.seed(21)
    mild, bad = "bread flour oven water salt dough crust".split(), "vermin scum filth".split()
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        said = [" ".join(random.choices(mild, k=6)) + (" " + random.choice(bad) if toxic and k == 1 or random.random() < 0.02 else "") for k in range(4)]
        rows.append((i, ". ".join(said)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    pull = 0.01
    how = {"features": 12, "least_documents": 2.0, "lift": 1.0}
    model = toxicity.fit(docs, marks, steps=1500, pull=pull, **how)
    sample = toxicity.training_rows(docs, marks, 10_000, 128 << 20)
    totals = {r["toxic"]: r["w"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    prior = toxicity.chosen_features(sample, (totals[0], totals[1]), *how.values())
    names = list(prior)
    assert set(model.weights) == set(names) and len(names) == 12
    bags = [(r.toxic, r.weight, [[f for w in s.split() for f in toxicity.word_features(w) if f in prior] for s in toxicity._SPLIT.split(bytes(r.text).decode().lower())]) for r in sample.collect()]
    whole = sum(w for _, w, _ in bags)
    start = {f: x / (1 + len(toxicity.PREFIXES)) for f, x in prior.items()}

    def loss(theta, bias):
        total = pull / 2 * sum((theta[f] - start[f]) ** 2 for f in names)
        for toxic, weight, sentences in bags:
            s = sum(math.log1p(math.exp(bias + sum(theta[f] for f in b))) for b in sentences if b)
            total += weight / whole * (-math.log(-math.expm1(-max(s, 1e-9))) if toxic else s)
        return total

    def slopes(theta, bias, h=1e-4):
        found = [(loss({**theta, f: theta[f] + h}, bias) - loss({**theta, f: theta[f] - h}, bias)) / (2 * h) for f in names]
        return np.array([*found, (loss(theta, bias + h) - loss(theta, bias - h)) / (2 * h)])

    at_start, at_end = slopes(start, -6.0), slopes(dict(model.weights), model.bias)
    assert np.abs(at_end).max() < 0.01 * np.abs(at_start).max()
    assert loss(dict(model.weights), model.bias) < loss(start, -6.0)
