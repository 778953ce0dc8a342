"""The functions that SQL has no form of, registered under their names for use in ``spark.sql``.

Arrow-batched functions read texts and pages; functions written in SQL are expanded into the query that uses them, so the optimizer sees
through them; table functions take a page, or a whole table that is partitioned and ordered in the query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.functions import geo, text
from millrace.operators import rules
from millrace.sources import pages


class CardsOf:
    """A table function: the cards of a result page, one row each."""

    def eval(self, html: str) -> Iterator[tuple]:
        for card in pages.parse_cards(html or ""):
            yield tuple(card[c] for c in ("job_id", "url", "title", "company", "location", "posted_at"))


class RunsOf:
    """A table function over a log: its runs of equal outcomes, in the order of the query.

    ``SELECT * FROM mr_runs(TABLE(log) PARTITION BY host ORDER BY (at), 'host')``. The table needs a column ``outcome`` and one ``at``; all columns
    it is to be told apart by are named in the second argument, ``'host'`` or ``'host,source'``, and are returned. Rows stream by; a
    partition's state is one run.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument has to be a table: TABLE(log) PARTITION BY ... ORDER BY ...")
        if not keys.isConstantExpression or not keys.value:
            raise ValueError("the second argument names the columns of the partitions, as a constant")
        kinds = {f.name: f for f in table.dataType.fields}
        wanted = [k.strip() for k in keys.value.split(",")]
        if missing := [c for c in [*wanted, "outcome", "at"] if c not in kinds]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        return AnalyzeResult(StructType([*(kinds[k] for k in wanted), StructField("outcome", kinds["outcome"].dataType), StructField("n", LongType()), StructField("began", kinds["at"].dataType), StructField("ended", kinds["at"].dataType)]))

    def __init__(self) -> None:
        self.now: tuple | None = None
        self.n, self.began, self.ended = 0, None, None

    def eval(self, row: Row, keys: str) -> Iterator[tuple]:
        own = (*(row[k.strip()] for k in keys.split(",")), row["outcome"])
        if self.n and own != self.now:
            yield (*self.now, self.n, self.began, self.ended)
            self.n = 0
        if not self.n:
            self.now, self.began = own, row["at"]
        self.n, self.ended = self.n + 1, row["at"]

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield (*self.now, self.n, self.began, self.ended)


def _sql_functions() -> dict[str, str]:
    """Name, parameters, type and body of the functions that are written in SQL."""
    forms = "|".join(text.LEGAL_FORMS)
    title = "trim(regexp_replace(regexp_replace({fold}, '[.\\\\x27’`]', ''), '[^a-z0-9]+', ' '))"
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    folded = f"lower(regexp_replace(translate(t, {quoted(text._MARKED)}, {quoted(text._PLAIN)}), '\\\\p{{Mn}}+', ''))"
    plain = title.format(fold=folded)
    return {
        "wilson_upper": """(hits BIGINT, trials BIGINT) RETURNS DOUBLE RETURN
            CASE WHEN trials = 0 THEN 1D ELSE least(1D, (hits / trials + 1.9208D / trials + 1.96D * sqrt(hits / trials * (1 - hits / trials) / trials + 0.9604D / (CAST(trials AS DOUBLE) * trials))) / (1 + 3.8416D / trials)) END""",
        "rate": "(hits BIGINT, trials BIGINT) RETURNS DOUBLE RETURN try_divide(CAST(hits AS DOUBLE), CAST(trials AS DOUBLE))",
        "title_key": f"(t STRING) RETURNS STRING RETURN {plain}",
        "company_key": f"(t STRING) RETURNS STRING RETURN regexp_replace({plain}, '( (?:{forms}))+$', '')",
        "language_passes": "(t STRING, language STRING) RETURNS BOOLEAN RETURN coalesce(length(t) < 40 OR language IS NULL OR language IN ('en', 'es', 'it'), true)",
    }


def register_all(spark: SparkSession, prefix: str = "mr_") -> list[str]:
    """Register all functions and table functions; returns their SQL names."""
    found = {
        "fold": text.fold_udf, "clean_text": text.clean_text, "work_mode": rules.work_mode, "countries": geo.countries_in, "page_cards": pages.cards_udf(), "page_description": pages.description_udf(),
        "policy_excerpt": text.policy_excerpt("remote|hybrid|office|on.?site|home", 1500),
    }
    for name, function in found.items():
        spark.udf.register(prefix + name, function)
    written = _sql_functions()
    for name, body in written.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name} {body}")
    spark.udtf.register(prefix + "cards", F.udtf(CardsOf, returnType="job_id string, url string, title string, company string, location string, posted_at string"))
    spark.udtf.register(prefix + "runs", F.udtf(RunsOf))
    return [prefix + name for name in (*found, *written, "cards", "runs")]
