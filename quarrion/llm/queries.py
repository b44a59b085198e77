"""The queries of the corpus operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import cuckoo, langid, linediff, matroska, mixing, packing, passages, quality, setjoin, toxicity
from quarrion.llm.common import crc_mod, table


#: Sweeps of op9, as SQL cannot stop at a tolerance: they bring every margin of sf0.01 within 1e-15 of its target.
SWEEPS = 12


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = quality.fit(docs, labels, "quality")
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    net = toxicity.fit(docs, labels, "toxic")
    return toxicity.score(docs, net).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linediff.aligned_lines(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(table(spark, sf_dir, "documents"), sweeps=SWEEPS)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_substring_dedup, op3_best_fit_packing, op4_language_id, op5_exact_dedup, op6_toxicity, op7_line_dedup, op8_ngram_jaccard_join, op9_mix_sources, op10_matroska)}



def mixing_sql() -> str:
    """The raking of ``mixing`` with its default targets, one common table expression for each step."""
    keys = ("source", "lang", "topic")
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) + 1"
    count = lambda chars: f"length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{chars}', ''))"
    steps = [
        f"""docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, n_tokens,
              CASE WHEN pipes * 4 >= n_tokens THEN 'table' WHEN marks >= n_tokens THEN 'marked' WHEN n_tokens <= 50 THEN 'short' ELSE 'prose' END AS topic
              FROM (SELECT *, {words} AS n_tokens, {count("|")} AS pipes, {count("!#$%&*")} AS marks FROM documents))""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL)",
    ]
    goals = "".join(f", g_{k}.goal AS goal_{k}" for k in keys)
    for k in keys:
        steps.append(f"g_{k} AS (SELECT {k}, x / sum(x) OVER () AS goal FROM (SELECT {k}, pow(CAST(sum(tokens) AS DOUBLE), {mixing.POWERS[k]}) AS x FROM cells GROUP BY {k}))")
    steps.append(f"w0 AS (SELECT cells.*, tokens / sum(tokens) OVER () AS weight{goals} FROM cells " + " ".join(f"JOIN g_{k} USING ({k})" for k in keys) + ")")
    for n in range(SWEEPS * 3):
        k = keys[n % 3]
        steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{k} / sum(weight) OVER (PARTITION BY {k}) AS weight) FROM w{n})")
    steps.append(f"r AS (SELECT source, lang, topic, round(ratio / max(ratio) OVER (), 9) AS rate FROM (SELECT *, weight * sum(tokens) OVER () / tokens AS ratio FROM w{SWEEPS * 3}))")
    draw = "CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, rate, {draw} < rate AS kept FROM docs JOIN r USING (source, lang, topic)"


def jaccard_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    """All pairs by shared shingles, and the least id that recursion reaches."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{small}'), '[^ \t\n\x0B\f\r]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
                                         ELSE [{shingle} FOR i IN range(1, len(w) - {k - 2})] END) AS s FROM words
        ), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
        ), reach AS (SELECT doc_id AS node, doc_id AS c FROM sets UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.node)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id FROM sets JOIN reach ON node = doc_id GROUP BY doc_id, s
    """


ORACLE: dict[str, str] = {
    "op8_ngram_jaccard_join": jaccard_sql(),
    "op9_mix_sources": mixing_sql(),
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
