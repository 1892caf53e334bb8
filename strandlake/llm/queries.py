"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, chunking, clusters, langid, lmscore, mixing, packing, quality, secrets, simhash, substrings, tandem
from .common import WORD, fold, load

#: The tokenizer of the packing query. Tokenizer files are never part of this repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Weights of the mixing query, dealt to the sources by code point, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False))
    model = quality.fit(docs, load(spark, sf_dir, "labels"), where=learn)
    out = quality.score(docs, model, score_col="score")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: A conversation whose texts hold the template's own marks.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    return chat.formatted(turns.union(marked))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), packing.word_encoder(TOKENIZER))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by cross-entropy difference; the target is what is labelled as of quality."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.score(docs, load(spark, sf_dir, "labels").filter("quality = 1")).drop("text")


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_edits(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs, weights=WEIGHTS, share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    out = langid.identify(docs.select("doc_id", "text"), model, reject=False)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.lloyd(load(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64, seed="1:")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.report(load(spark, sf_dir, "documents"), exponent=4, least=6, change=tandem.repeated)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_chat_format,
        op3_packing,
        op4_lm_scoring,
        op5_chunk_fingerprints,
        op6_source_mixing,
        op7_simhash_dedup,
        op8_nearest_neighbours,
        op9_language_id,
        op10_substring_dedup,
        op11_centroid_clustering,
        op12_secret_scan,
        op13_periodic_runs,
    )
}

def _lloyd_sql(k: int, rounds: int) -> str:
    """Rounds of Lloyd, one table expression each."""
    finite = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {finite})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        d = "CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (SELECT kept.*, c, {d} AS d FROM kept CROSS JOIN c{i}) GROUP BY r)")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM
                (SELECT best.c AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS j) GROUP BY best.c, j) GROUP BY c)""")
            parts.append(f"c{i + 1} AS (SELECT c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.c = c"""


SQL: dict[str, str] = {
    "op2_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f AS (SELECT *, length(text) + length(regexp_replace(text, '[^<\[]', '', 'g')) AS body, length(role) + length(regexp_replace(role, '[^<\[]', '', 'g')) AS name FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(body + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE name + 12 END) AS BIGINT) AS formatted_chars,
            CAST(formatted_chars * (formatted_chars - 1) // 2 AS BIGINT) AS position_sum
        FROM f GROUP BY conv_id""",
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
        windows AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS k FROM starts),
        again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
        gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM again) GROUP BY doc_id),
        kept AS (SELECT w.doc_id, len(words) AS n, coalesce(len(g), 0) AS r, CASE WHEN g IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(g, i)) END AS k FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op11_centroid_clustering": _lloyd_sql(16, 3),
}
