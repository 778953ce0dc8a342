"""The registered queries of the corpus operators: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, chat, class_lm, exact_dedup, langid, media, merkle, near_dedup, packing, sp_codec, token_counts, toxicity, url_filter
from millrace.llm.common import documents


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(documents(spark, sf_dir))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.codec_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), percent=85)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    turns = turns.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    records = turns.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("record"))
    return chat.read_back(chat.formatted(chat.canonical_turns(records, "conv_id", "record", "turn")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def how_to_pack() -> packing.Packing:
    """The production parameters. The ranks are the same vocabulary as ``byte_bpe_50k.json``; the tests hold the two against each other."""
    return packing.Packing(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=1, tokens=2048)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir), how_to_pack())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir)).drop("proof")


#: The rules of the query: verdict, host, path.
URL_RULES = [url_filter.Rule(*x) for x in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.fit(pages, URL_RULES))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(documents(spark, sf_dir), how)


QUERIES = {f.__name__: f for f in (op1_class_lm, op2_sentencepiece_codec, op3_near_dedup, op4_chat_formatting, op5_toxicity, op6_exact_dedup, op7_packing, op8_language_id, op9_media_columns, op10_token_counts, op11_merkle_manifest, op12_url_filter, op13_token_alignment)}

#: Occurrences of the control strings in ``t``; none of them is a prefix of another or overlaps itself.
_CONTROLS = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)

ORACLES = {
    "op4_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(r) + 1 + length(t) + (length(t) - length(replace(t, chr(92), ''))) + 2 * ({_CONTROLS}) + {len(chat.OPEN) + len(chat.CLOSE)} AS n FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    # levels of each language's tree, one step of the recursion each; then the same over the languages' roots
    "op11_merkle_manifest": """
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, n_chars,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
                   coalesce(strlen(text) || ':' || text, '-') AS after,
                   list_reduce(
                       list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
                       lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))
                   ) AS crc
            FROM documents
        ), leaf AS (
            SELECT doc_id, lang, sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
                   CASE WHEN coalesce(xor(crc, 4294967295), 0) % 7 = 0 THEN sha256(before || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || after) END AS tampered
            FROM fields
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
        ), trees AS (
            SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
            UNION ALL
            SELECT lang, level + 1, [sha256(nodes[i] || coalesce(nodes[i + 1], '')) FOR i IN range(1, len(nodes) + 1, 2)] FROM trees WHERE len(nodes) > 1
        ), tops AS (
            SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1
        ), over AS (
            SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM tops
            UNION ALL
            SELECT level + 1, [sha256(nodes[i] || coalesce(nodes[i + 1], '')) FOR i IN range(1, len(nodes) + 1, 2)] FROM over WHERE len(nodes) > 1
        ), root AS (
            SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1
        ), steps AS (
            SELECT p.doc_id, p.lang, p.pos, t.level, CASE WHEN (p.pos >> t.level) % 2 = 1 THEN 'L' ELSE 'R' END AS side, t.nodes[xor(p.pos >> t.level, 1) + 1] AS sibling
            FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
            UNION ALL
            SELECT p.doc_id, p.lang, p.pos, 1000 + o.level, CASE WHEN (s.place >> o.level) % 2 = 1 THEN 'L' ELSE 'R' END, o.nodes[xor(s.place >> o.level, 1) + 1]
            FROM placed p JOIN tops s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN over o WHERE len(o.nodes) > 1
        ), paths AS (
            SELECT lang, pos, list(CASE WHEN sibling IS NULL THEN '' ELSE side || sibling END ORDER BY level) AS path, coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings FROM steps GROUP BY lang, pos
        ), folded AS (
            SELECT p.doc_id, p.lang, p.leaf, s.subroot, sha256(coalesce(w.siblings, '')) AS proof_sha256,
                   list_reduce(list_prepend(coalesce(p.tampered, p.leaf), coalesce(w.path, [])), lambda a, x: sha256(CASE WHEN x = '' THEN a WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
            FROM placed p JOIN tops s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos = w.pos
        )
        SELECT doc_id, lang, leaf, subroot, proof_sha256, folded_root, root, folded_root = root AS verified FROM folded, root
    """,
}
