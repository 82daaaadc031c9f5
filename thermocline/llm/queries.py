"""Registered queries of the corpus operators, over whole tables, with their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.llm import chosen_path, conversation_repair, decontaminate, hard_negatives, language, licenses, mixing, pseudonyms, quality, sharding, simhash, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Water level by running sums, then exponential keys and one cut per source, as in mixing.mix.
MIX_SQL = r"""
WITH d AS (
    SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
        length(text) AS n, length(text) - length(translate(text, '#*$%&|<>', '')) AS marks FROM documents),
k AS (
    SELECT *, -ln((('0x' || left(md5('7|' || concat_ws('|', doc_id, digest)), 12))::BIGINT::DOUBLE + 1.0) / 281474976710656.0)
        / coalesce(greatest(0.05, 1.0 - 5.0 * marks / nullif(n, 0)), 0.05) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM k GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM s),
v AS (
    SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM v WHERE cap / weight > level),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM w),
e AS (SELECT *, coalesce(least(floor(target / nullif(source_size, 0)), 3), 0)::BIGINT AS epochs FROM t),
p AS (
    SELECT k.source, k.key, k.size, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT source, max(key) AS edge FROM p WHERE rest - before > 0 AND 2.0 * (rest - before) >= size GROUP BY source)
SELECT k.doc_id, k.size, e.source_size, round(e.target, 4) AS target,
    (k.size * (e.epochs + CASE WHEN k.key <= c.edge THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source
"""


@query("op3_mixing_to_target_weights", MIX_SQL)
def mixing_to_target_weights(spark, sf):
    taken = mixing.mix(table(spark, sf, "documents"))
    return taken.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_byte_balanced_shards")
def byte_balanced_shards(spark, sf):
    placed = sharding.document_shards(table(spark, sf, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_token_files")
def token_id_files(spark, sf):
    tokens = token_files.token_table(table(spark, sf, "documents").select("doc_id", "text"))
    return tokens.withColumnRenamed("key", "doc_id")


@query("op2_robust_outliers")
def robust_outliers(spark, sf):
    judged = quality.quality_rules(table(spark, sf, "documents"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query("op6_simhash_components")
def simhash_components(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op9_license_scan")
def license_scan(spark, sf):
    return licenses.license_scan(table(spark, sf, "documents"))


@query("op1_feistel_pseudonyms")
def feistel_pseudonyms(spark, sf):
    """The key is a parameter of the operator; a real one comes from a secret store."""
    named = pseudonyms.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), key="example key")
    return named.select("doc_id", "text", "n_replaced")


@query("op8_bm25_decontamination")
def bm25_decontamination(spark, sf):
    """Documents that hold a test item, with the item and the scores."""
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_byte_language_id")
def byte_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    tagger = language.train_tagger(docs.where(~out))
    return language.predict_language(docs, tagger).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op10_gru_toxicity")
def gru_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    out = language.held_out(F.col("doc_id"), 5, 0)
    scorer = toxicity.train_scorer(docs.where(~out), table(spark, sf, "labels").where(~out))
    return toxicity.score_toxicity(docs, scorer).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


# Every pair of an anchor and a row; whole numbers below 2^53 are exact in doubles.
NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negative_rows(spark, sf):
    rows = hard_negatives.prepared(table(spark, sf, "embeddings"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


# Every pair of documents with a common shingle, then all that can be reached.
SHINGLES_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@query("op12_chosen_path_components", SHINGLES_SQL)
def chosen_path_components(spark, sf):
    return chosen_path.similar_components(table(spark, sf, "documents"))


def _cheapest(options: str) -> str:
    return f"list_sort([{options}])[1]"


def _option(cost: str, initial: str, state: int, given: str = "true") -> str:
    return f"CASE WHEN {given} THEN {{'c': {cost} + f[{state}].c, 'a': '{initial}' || f[{state}].a}} ELSE {{'c': 1000000000, 'a': ''}} END"


def _inserted(state: int, chain: tuple[int, ...]) -> str:
    more = [f"{{'c': {3 * k} + g[{s}].c, 'a': '{'I' * k}' || g[{s}].a}}" for k, s in enumerate(chain, 1)]
    return _cheapest(", ".join([f"g[{state}]", *more]))


# Cost and audit from the end of each conversation: f holds the states start, system, user, assistant; one recursive step a row.
REPAIR_SQL = rf"""
WITH RECURSIVE polynomial AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)),
r AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (
    SELECT r.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate FROM r, polynomial),
e AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE fate <> 0),
o AS (
    SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*$', 1) AS mark, left(role, 1) AS i, lag(left(role, 1)) OVER w AS j
    FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
l AS (
    SELECT *, mark = '' AS blank, mark <> '' AND again AS duplicate, mark <> '' AND NOT again AND mark NOT IN ('.', '!', '?') AS truncated,
        mark = '' OR again AS gone, CASE WHEN mark <> '' AND NOT again AND mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM o),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
        count_if(duplicate)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated, count_if(j || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
    FROM l GROUP BY conv_id),
steps AS (
    SELECT conv_id, n AS k, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS f FROM counts
    UNION ALL
    SELECT conv_id, k, [{_inserted(1, (3, 4))}, {_inserted(2, (3, 4))}, {_inserted(3, (4, 3))}, {_inserted(4, (3, 4))}] AS f
    FROM (
        SELECT s.conv_id, s.k - 1 AS k, [
            {_cheapest(", ".join([_option("4", "D", 1), _option("more", "K", 2, "NOT gone AND i = 's'"), _option("more", "K", 3, "NOT gone AND i = 'u'"), _option("3 + more", "R", 3, "NOT gone")]))},
            {_cheapest(", ".join([_option("4", "D", 2), _option("more", "K", 3, "NOT gone AND i = 'u'"), _option("3 + more", "R", 3, "NOT gone")]))},
            {_cheapest(", ".join([_option("4", "D", 3), _option("more", "K", 4, "NOT gone AND i = 'a'"), _option("3 + more", "R", 4, "NOT gone")]))},
            {_cheapest(", ".join([_option("4", "D", 4), _option("more", "K", 3, "NOT gone AND i = 'u'"), _option("3 + more", "R", 3, "NOT gone")]))}] AS g
        FROM steps s JOIN l ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.k = l.k)),
best AS (SELECT conv_id, f[1].c::BIGINT AS cost, f[1].a AS audit FROM steps WHERE k = 0),
edits AS (SELECT conv_id, generate_subscripts(string_split(audit, ''), 1) AS place, unnest(string_split(audit, '')) AS edit FROM best WHERE audit <> ''),
placed AS (SELECT *, count_if(edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS k FROM edits),
made AS (
    SELECT p.conv_id, place, edit, role, i, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, row_number() OVER w AS q,
        first_value(edit = 'K' AND i = 's') OVER w AS led
    FROM placed p LEFT JOIN l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.k = l.k AND edit <> 'I' WHERE edit <> 'D'
    WINDOW w AS (PARTITION BY p.conv_id ORDER BY place)),
repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY place) AS text FROM made GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN repaired ON ids.conv_id IS NOT DISTINCT FROM repaired.conv_id
"""


@query("op13_conversation_repair", REPAIR_SQL)
def conversation_repairs(spark, sf):
    return conversation_repair.repair_damaged(table(spark, sf, "conversations"))
