"""Languages of texts, from trigram profiles that are learned and kept as a table.

A profile row says how likely a trigram is in a language, as thousandths of the natural logarithm, so that sums of them are
exact and don't depend on their order. Profiles of up to ``MOST_GRAMS`` trigrams go to every task, which scores its texts letter by letter; with larger
ones texts are scored by joins on their distinct words, whose trigrams are looked up once for the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import shared_table

#: The row of a profile that stands for all trigrams a language hasn't.
UNSEEN = "?"
#: Most rows of profiles that are sent to every task.
MOST_GRAMS = 1_000_000
_PIECE = 1 << 20


def words(text: Column) -> Column:
    """The runs of letters of a text, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """All three-letter stretches of a word with a space before and after it."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """gram, lang, score: learned from all rows with a language, with one occurrence added to each trigram; ``UNSEEN`` for those a language hasn't."""
    counted = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    grams = counted.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    grams = shared_table(grams, df.sparkSession)  # read for the sums and for the scores
    size = grams.agg(F.count_distinct("gram").alias("v"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total")).join(F.broadcast(size))  # a row for each language
    score = lambda n: F.round(1000 * F.ln((n + 1) / (F.col("total") + F.col("v")))).cast("long")
    seen = grams.join(F.broadcast(totals), "lang").select("gram", "lang", score(F.col("n")).alias("score"))
    return seen.unionByName(totals.select(F.lit(UNSEEN).alias("gram"), "lang", score(F.lit(0)).alias("score")))


class _Profiles:
    """Scores of trigrams by their three code points, in order, with a row for those that no language has."""

    def __init__(self, table: pa.Table) -> None:
        columns = [table.column(c).to_pylist() for c in ("gram", "lang", "score")]
        self.langs = sorted(set(columns[1]))
        unseen = {lang: score for gram, lang, score in zip(*columns, strict=True) if gram == UNSEEN}
        place = {gram: k for k, gram in enumerate(sorted({g for g in columns[0] if g != UNSEEN}))}
        self.scores = np.tile(np.array([unseen[x] for x in self.langs], np.int64), (len(place) + 1, 1))
        at = {lang: k for k, lang in enumerate(self.langs)}
        for gram, lang, score in zip(*columns, strict=True):
            if gram != UNSEEN:
                self.scores[place[gram], at[lang]] = score
        codes = np.frombuffer("".join(place).encode("utf-32-le"), np.uint32).reshape(-1, 3).astype(np.uint64)
        self.keys = codes[:, 0] << np.uint64(42) | codes[:, 1] << np.uint64(21) | codes[:, 2]  # by code points, as strings sort

    def language(self, words: str) -> str | None:
        """The likeliest language of words with one space before, between and after them."""
        total, letters = np.zeros(len(self.langs), np.int64), 0
        for k in range(0, len(words) - 2, _PIECE):
            c = np.frombuffer(words[k : k + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            grams = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[c[1:-1] != 32]  # a trigram for each letter
            letters += len(grams)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
                at = np.where(self.keys[at] == grams, at, len(self.keys))
                total += np.bincount(at, minlength=len(self.scores)) @ self.scores
        return self.langs[int(total.argmax())] if letters and self.langs else None


def detected(df: DataFrame, key: str, table: DataFrame, text: str = "text", least: int = 40) -> DataFrame:
    """key and language of every row, the likeliest by the profile ``table`` (of equal ones the first by name); null for texts under ``least`` characters or without a word, which the gate lets pass."""
    if table.limit(MOST_GRAMS + 1).count() > MOST_GRAMS:
        return _joined(df, key, table, text, least)
    held = df.sparkSession.sparkContext.broadcast(_Profiles(table.select("gram", "lang", "score").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.language(x) if x else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=batch.schema.names[:1] + ["language"])

    own = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" ")), r"[^\p{L}]+", " ")
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.when(F.length(F.trim(text)) >= least, own).alias("_words")).mapInArrow(run, f"`{key}` {kind}, language string")


def _joined(df: DataFrame, key: str, table: DataFrame, text: str, least: int) -> DataFrame:
    """:func:`detected` by joins, for profiles of any size."""
    own = df.select(key, F.explode(words(F.when(F.length(F.trim(text)) >= least, F.col(text)))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    unseen = table.filter(F.col("gram") == UNSEEN).select("lang", F.col("score").alias("unseen"))
    grams = own.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    told = grams.join(table, "gram").join(F.broadcast(unseen), "lang").groupBy("word", "lang").agg(F.sum(F.col("score") - F.col("unseen")).alias("gain"))
    gains = own.join(told, "word").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    sizes = own.groupBy(key).agg(F.sum(F.col("n") * F.length("word")).alias("grams"))  # a word has as many trigrams as letters
    scored = sizes.join(F.broadcast(unseen)).join(gains, [key, "lang"], "left").withColumn("score", F.col("grams") * F.col("unseen") + F.coalesce("gain", F.lit(0)))
    best = scored.groupBy(key).agg(F.min(F.struct(-F.col("score"), "lang"))["lang"].alias("language"))
    return df.select(key).join(best, key, "left")
