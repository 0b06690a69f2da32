"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import OPEN, expanded, formatted, turns_of, unescape
from .jaccard import near_duplicates
from .lm import backoff_scores
from .mixing import mix_positions
from .pieces import encode_pieces
from .pii import KINDS, find_personal_data
from .repeats import remove_repeats
from .rules import judge, learn_rules
from .sharding import shard
from .topk import top_k

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target weights: one source holds a third of the rows but gets a tenth of the mix.
WEIGHTS = {"src0": 0.10, **{f"src{i}": 0.03 + 0.002 * i for i in range(1, 20)}}


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_positions(_table(spark, sf_dir, "documents"), WEIGHTS, block_rows=64, seed=17)


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(_table(spark, sf_dir, "documents"), dropout=0.1, seed=29)
    said = F.sha2(F.array_join("ids", " "), 256)
    return encoded.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_ids"), said.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")))
    fit = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = _table(spark, sf_dir, "embeddings").where(fit).select("vec_id", real.alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = formatted(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    each = expanded("formatted", "spans", lambda prompt, reply: F.struct((F.length(prompt) - len(f"{OPEN}assistant\n")).cast("long").alias("context"), unescape(reply).alias("reply")))
    made = chats.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), each.alias("examples"))
    read = made.select("*", F.array_join(F.col("examples.reply"), "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    context = F.aggregate("examples", F.lit(0).cast("long"), lambda a, e: a + e["context"])
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("examples").cast("long").alias("n_examples"), context.alias("context_chars"))


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, 9 + length(role) + length(regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>))', '\\\1', 'g')) AS size FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text) - size AS start FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(start) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM s GROUP BY conv_id
"""


def op5_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backed_off", "n_unseen", F.round("log_score", 4).alias("log_score"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
t AS (SELECT doc_id, p, x, lag(x) OVER (PARTITION BY doc_id ORDER BY p) AS v FROM p),
u AS (SELECT x, count(*) AS c FROM t GROUP BY x),
ud AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY doc_id, x),
b AS (SELECT v, x, count(*) AS c FROM t WHERE p > 1 GROUP BY v, x),
bd AS (SELECT doc_id, v, x, count(*) AS c FROM t WHERE p > 1 GROUP BY doc_id, v, x),
n AS (SELECT count(*) AS n FROM t),
j AS (SELECT t.doc_id, t.p, n.n - len(d.w) AS rest, u.c - ud.c AS one, u1.c - ud1.c AS prev, b.c - bd.c AS two
      FROM t CROSS JOIN n JOIN d USING (doc_id) JOIN u ON u.x = t.x JOIN ud ON ud.doc_id = t.doc_id AND ud.x = t.x
      LEFT JOIN u u1 ON u1.x = t.v LEFT JOIN ud ud1 ON ud1.doc_id = t.doc_id AND ud1.x = t.v
      LEFT JOIN b ON b.v = t.v AND b.x = t.x LEFT JOIN bd ON bd.doc_id = t.doc_id AND bd.v = t.v AND bd.x = t.x),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (p > 1 AND two = 0) AS n_backed_off,
        count(*) FILTER (one = 0 AND (p = 1 OR two = 0)) AS n_unseen,
        sum(ln(CASE WHEN p > 1 AND two > 0 THEN two::DOUBLE / prev ELSE (CASE WHEN p > 1 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) *
          (CASE WHEN one > 0 THEN one::DOUBLE / rest ELSE 1::DOUBLE / (rest + 1) END) END)) AS log_score
      FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen,
  round(coalesce(log_score, 0::DOUBLE), 4) AS log_score
FROM d LEFT JOIN s USING (doc_id)
"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS f FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id FROM n)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.class_id, d.doc_id) AS class_id
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = learn_rules(docs, _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, rules).select(*columns)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    fixed = F.filter("spans", lambda s: s["fixed"])
    kinds = F.transform(fixed, lambda s: s["kind"])
    counts = [(F.size(fixed) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(said(fixed), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), (F.size("spans") - F.size(fixed)).cast("long").alias("n_added"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM f),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT p.doc_id, count(c.p) AS n_removed, string_agg(x, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op1_pfair_mix": op1_pfair_mix, "op2_merge_dropout": op2_merge_dropout, "op3_top_k": op3_top_k, "op4_chat_prefix_targets": op4_chat_prefix_targets, "op5_best_fit_shards": op5_best_fit_shards, "op6_lm_scores": op6_lm_scores, "op7_ngram_jaccard": op7_ngram_jaccard, "op8_quality_rules": op8_quality_rules, "op9_personal_data": op9_personal_data, "op10_substring_dedup": op10_substring_dedup}
ORACLES = {"op3_top_k": OP3_SQL, "op4_chat_prefix_targets": OP4_SQL, "op6_lm_scores": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op10_substring_dedup": OP10_SQL}
