"""CVs as lines: sections, roles and bullets of Markdown documents, and what a tailored one may change.

A document is a few hundred lines at most, so its lines are put in order by a window of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Past forms that don't end in "ed".
IRREGULAR = ("built", "led", "sent", "ran", "wrote", "made", "grew", "gave", "chose", "began", "brought", "bought", "caught", "taught", "sought", "fought", "thought", "spent", "kept", "left", "met", "found", "sold", "told", "held", "won", "sat", "hit", "cut", "put", "shut", "spread", "cast", "shot", "set", "let", "hurt", "bet", "cost", "quit")


def _raw_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "raw"))


def _bare(raw: Column) -> Column:
    """A line without white space at its ends."""
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def _kind(raw: Column) -> Column:
    t = _bare(raw)
    return (
        F.when(t.startswith("## "), "section")
        .when(t.rlike(r"^- lp\.\S+\s*::\s*\S"), "proof")
        .when(t.startswith("- "), "bullet")
        .when(t.rlike(r"^\*\*[^:*]+:\*\*"), "skill")
        .when(t.rlike(r"^\*\*.+\*\*$") & ~raw.startswith(" "), "role")
        .otherwise("text")
    )


def cv_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, section, role, kind (section, role, bullet, skill, proof, text) and content of every line that isn't blank.

    A section begins with ``## ``, a role with a line in bold, a skill with ``**label:**``; bullets begin with ``- `` and
    proofs of letters with ``- lp.name :: ``. Lines before the first section have none.
    """
    lines = _raw_lines(df, key, text).filter(_bare(F.col("raw")) != "")
    t = _bare(F.col("raw"))
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumns({"kind": _kind(F.col("raw")), "content": F.when(t.startswith("## "), F.substr(t, F.lit(4))).when(t.startswith("- "), F.substr(t, F.lit(3))).when(t.rlike(r"^\*\*.+\*\*$"), F.regexp_replace(t, r"^\*\*|\*\*$", "")).otherwise(t)})
    named = found.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("content")), ignorenulls=True).over(upto))
    # a role ends with its section
    role = F.last(F.when(F.col("kind") == "role", F.col("content")).when(F.col("kind") == "section", ""), ignorenulls=True).over(upto)
    return named.withColumn("role", F.when(role != "", role)).select(key, "line", "section", "role", "kind", "content")


def budgets(lines: DataFrame, key: str) -> DataFrame:
    """Per role: its bullets and their characters, in order, which a tailored CV has to keep to."""
    own = lines.filter("kind = 'bullet' AND role IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("line", F.length("content").alias("chars"))))  # the bullets of one role
    return own.groupBy(key, "role").agg(F.count("*").alias("bullets"), F.transform(listed, lambda x: x["chars"]).alias("chars"))


def is_sentence(bullet: Column) -> Column:
    """Whether a bullet reads as a sentence in the past: its first word is a past form."""
    word = F.lower(F.regexp_extract(bullet, r"^[A-Za-z-]+", 0))
    return word.isin(*IRREGULAR) | word.endswith("ed")


def changed_bullets(tailored: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Bullets of a tailored CV that aren't, byte by byte, among its master's. Both as :func:`cv_lines` gives them."""
    own = lambda df: df.filter("kind = 'bullet'").select(key, "content")
    return own(tailored).distinct().join(own(master).distinct(), [key, "content"], "left_anti")


def missing_metrics(tailored: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Figures (key, metric) that a tailored CV has to name and doesn't."""
    text = tailored.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "content"))).getField("content"), "\n").alias("_text"))  # one document's lines
    return required.join(text, key, "left").filter(~F.coalesce(F.contains("_text", F.col("metric")), F.lit(False))).select(key, "metric")


def _slots(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, raw, role_no (roles from 1 on; null outside of one) and place (of a role's bullets, from 1 on; null for other lines)."""
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = _raw_lines(df, key, text).withColumn("kind", _kind(F.col("raw")))
    opened = F.last(F.when(F.col("kind") == "role", F.lit(True)).when(F.col("kind") == "section", F.lit(False)), ignorenulls=True).over(upto)
    lines = lines.withColumn("role_no", F.when(opened, F.count_if(F.col("kind") == "role").over(upto)))
    bullet = (F.col("kind") == "bullet") & F.col("role_no").isNotNull()
    own = Window.partitionBy(key, "role_no").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("place", F.when(bullet, F.count_if(bullet).over(own)))


def assembled(df: DataFrame, key: str, text: str, plan: DataFrame) -> DataFrame:
    """key and the text in which the plan's bullets stand at their places; all else, indents and blanks at line ends too, stays byte by byte.

    plan: key, role_no (from 1 on), place (of the role's bullets, from 1 on), content. Places without a row stay as they are.
    """
    lines = _slots(df, key, text).join(plan.select(key, "role_no", "place", "content"), [key, "role_no", "place"], "left")
    new = F.concat(F.regexp_extract("raw", r"^(\s*- )", 1), "content", F.regexp_extract("raw", r"(\s*)$", 1))
    listed = F.array_sort(F.collect_list(F.struct("line", F.when(F.col("content").isNull(), F.col("raw")).otherwise(new).alias("raw"))))  # one document's lines
    return lines.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["raw"]), "\n").alias(text))


def plan_problems(df: DataFrame, key: str, text: str, plan: DataFrame) -> DataFrame:
    """key, role_no, place and problem of a plan's rows that can't be carried out: no such bullet, several rows for one, a line break, or longer than what stands there."""
    there = _slots(df, key, text).filter("place IS NOT NULL").select(key, "role_no", "place", F.length(F.substr(_bare(F.col("raw")), F.lit(3))).alias("chars"))
    rows = plan.groupBy(key, "role_no", "place").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("longest"), F.bool_or(F.contains("content", F.lit("\n"))).alias("broken"))
    found = rows.join(there, [key, "role_no", "place"], "left")
    problem = F.when(F.col("chars").isNull(), "no such bullet").when(F.col("n") > 1, "several rows").when(F.col("broken"), "line break").when(F.col("longest") > F.col("chars"), "too long")
    return found.withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "role_no", "place", "problem")
