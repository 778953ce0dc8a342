"""The pipeline against its stages done plainly, and the registered queries with SQL."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import langid, queries, toxicity
from millrace.llm.common import written
from tests.llm.test_dedup import brute_components, brute_sets

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    left = docs.filter(~docs["doc_id"].isin(list(toxic)) if toxic else "true")
    spoken = {r.doc_id for r in langid.identify(left, langid.fit(left)).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE}
    owner = {}
    for i in sorted(spoken):
        owner[text[i].encode().lower()] = i
    kept = set(owner.values())
    roots = brute_components(brute_sets([(i, text[i]) for i in kept]), 80)
    want = {i for i in kept if roots[i] == i}
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(SF)).select("doc_id").distinct().collect()}
    assert got == want and len(want) < len(text)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(60), str(SF))
        assert out.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "near_dedup", "packing"]


WORDS = "the house and the river were under the green tree while people walked along old roads to town".split()
OTHERS = "der hund und die katze sind unter dem tisch waehrend leute auf alten wegen gehen".split()


def odd_documents():
    """Rows with null and repeated identifiers, toxic and clean texts of one identifier, copies and near copies."""
    random.seed(3)
    some = lambda words, n: " ".join(random.choices(words, k=n))
    rows = [(i, some(WORDS if i % 3 else OTHERS, 40) + (" vermin" if i % 5 == 0 else ""), "en" if i % 3 else "de") for i in range(150)]
    near = some(WORDS, 60)
    rows += [(900, "clean " + near, "en"), (900, some(WORDS, 30) + " vermin", "en"), (None, near, "en"), (None, near + " again", None), (None, near.upper(), "en"), (901, near, "en"), (901, near, "en")]
    rows += [(910, None, "en"), (911, "", None), (912, " \n", "en"), (913, "12 34 !!", "en"), (None, None, None), (914, some(WORDS, 30_000), "en"), (915, "word", "en"), (916, "Word", None)]
    labels = [(i, int(i % 5 == 0)) for i in range(150)] + [(None, 1), (5, None)]
    return rows, labels


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, tmp_path, empty):
    rows, labels = odd_documents()
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 3) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars int, rep int, component_id int, toxic int")
    (df.limit(0) if empty else df.repartition(3)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
        kept[name] = docs.collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert not got
        return
    words = lambda r: (r.text or "").lower()
    assert all("vermin" not in words(r) for r in kept["toxicity"]) and len(kept["toxicity"]) == sum("vermin" not in (t or "") for _, t, _ in rows)
    spoken = [r for r in kept["toxicity"] if any(c.isalpha() for c in words(r))]
    assert sorted(map(str, kept["language_id"])) == sorted(map(str, spoken))
    texts = [words(r) for r in kept["exact_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {words(r) for r in spoken}
    for r in kept["exact_dedup"]:
        same = [x.doc_id for x in spoken if words(x) == words(r) and x.doc_id is not None]
        assert r.doc_id == (max(same) if same else None)
    numbered = dict(enumerate(kept["exact_dedup"]))
    roots = brute_components(brute_sets([(k, r.text) for k, r in numbered.items()]), 80)
    groups = {}
    for k, root in roots.items():
        groups.setdefault(root, []).append(numbered[k])
    want = [min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept["near_dedup"]) == sorted(want) and len(want) < len(numbered)
    assert sum(r.start == 0 for r in got) == len(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in SF.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, str(SF)).toArrow()
    names = sorted(want.column_names)
    rows = lambda t: sorted(tuple(str(r[n]) for n in names) for r in t.to_pylist())
    assert sorted(got.column_names) == names and rows(got) == rows(want)
