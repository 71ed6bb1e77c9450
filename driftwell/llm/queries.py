"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid_crf import identify

    return identify(read(spark, sf_dir, "documents"))


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm_score import score_texts

    return score_texts(read(spark, sf_dir, "documents"))


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_net import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_channel import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_graph import near_duplicate_vectors

    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"))


PSEUDONYM_KEY = "a fixed key, so that reruns agree; a deployment passes its own"
QUERIES = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_language_crf, op3_pii_feistel, op4_decontamination, op5_vector_graph, op6_hmm_score, op7_quality_net, op8_suffix_dedup, op9_toxicity, op10_mixing)
}

# Words and shingles as SQL: one shingle for a text with fewer words, none without words.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, k: int) -> str:
    grams = f"list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))"
    cut = f"CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE {grams} END"
    return f"SELECT DISTINCT {key}, unnest({cut}) AS s FROM (SELECT {key}, {_WORDS} AS ws FROM {table} WHERE text IS NOT NULL)"


_REACH = "reach(a, b) AS (SELECT {id}, {id} FROM {table} UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)"
ORACLES = {
    "op1_minhash_dedup": f"""WITH RECURSIVE sh AS ({_shingles('documents', 'doc_id', 4)}), n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)), {_REACH.format(id='doc_id', table='documents')},
comp AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a) SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_decontamination": f"""WITH d AS ({_shingles('documents', 'doc_id', 5)}), i AS ({_shingles('benchmark', 'item_id', 5)}), n AS (SELECT item_id, COUNT(*) AS n FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, COUNT(*) AS c FROM d JOIN i USING (s) GROUP BY 1, 2) SELECT doc_id, item_id, c AS n_shared, n AS n_item, CAST(c AS DOUBLE) / n AS containment FROM m JOIN n USING (item_id) WHERE 100 * c >= 80 * n""",
    "op5_vector_graph": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH.format(id='vec_id', table='embeddings')}, comp AS (SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)""",
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, HEX(ENCODE(COALESCE(text, ''))) AS h, OCTET_LENGTH(ENCODE(COALESCE(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, 1000 * q AS base, SUBSTR(h, 2000 * q + 1, 2100) AS part FROM (SELECT doc_id, h, n, UNNEST(RANGE(0, n // 1000 + 1)) AS q FROM d)),
s AS (SELECT doc_id, base + r AS p, SUBSTR(part, 2 * r + 1, 100) AS g FROM (SELECT *, UNNEST(RANGE(0, LEAST(1000, GREATEST(0, n - 49 - base)))) AS r FROM c)), f AS (SELECT g, MIN(doc_id) AS first FROM s GROUP BY g),
hit AS (SELECT s.doc_id, p, LAG(p) OVER (PARTITION BY s.doc_id ORDER BY p) AS prev FROM s JOIN f USING (g) WHERE first < s.doc_id), isl AS (SELECT *, SUM(CASE WHEN p <= prev + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
runs AS (SELECT doc_id, k, MIN(p) AS a, MAX(p) + 50 AS b FROM isl GROUP BY doc_id, k), r AS (SELECT *, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT r.doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans, STRING_AGG(SUBSTR(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || SUBSTR(ANY_VALUE(h), 2 * MAX(b) + 1) AS rest FROM r JOIN d USING (doc_id) GROUP BY r.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, SHA256(UNHEX(COALESCE(rest, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
}
