"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.llm import (
    audit, bpe, chat, containment, packing, pii, probminhash, quality, records, secrets, spans, toxicity, vafile, whitening,
)
from gainsay.llm.common import read, shared_folder, staged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query()
def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(packing.pack(read(spark, sf_dir, "documents")))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "sequence_tokens", "step_group",
    )


@query()
def op5_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "records")
    records.write_records(read(spark, sf_dir, "documents"), folder)
    return records.read_records(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER () AS place
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.place <> c.place)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
""")
def op3_vector_approximation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.whole_vectors(read(spark, sf_dir, "embeddings"))
    found = vafile.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
    return found.select("query_id", "rank", "vec_id", "score")


# A conversation that is nothing but control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text))
         AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_examples,
       CAST(sum(CASE WHEN role = 'assistant' THEN before ELSE 0 END) AS BIGINT) AS context_chars,
       CAST(sum(CASE WHEN role = 'assistant' THEN before + size ELSE 0 END) AS BIGINT) AS example_chars
FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
                      + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS size
            FROM turns))
GROUP BY conv_id
""")
def op8_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT).alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = staged(chat.segments(turns.unionByName(control)), "chat")
    whole = chat.parsed(formatted).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    # All from the texts of the examples as written out.
    pieces = chat.written(chat.examples(formatted).drop("reply"), formatted)
    learned = chat.trained(pieces).groupBy(F.col("conv_id").alias("of")).agg(
        F.count_if("last").alias("n_examples"),
        F.sum("context_chars").alias("context_chars"),
        F.sum("chars").alias("example_chars"),
        F.array_sort(F.collect_list(F.when(F.col("last"), F.struct("target", "reply")))).alias("replies"),
    )
    line = F.lit("\n")
    said = F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line))
    trained = F.coalesce(F.array_join("replies.reply", ""), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return whole.join(learned, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
        *[number(c) for c in ("n_examples", "context_chars", "example_chars")],
    )


@query()
def op4_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probminhash.near_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


_SHINGLES_SQL = r"""
  SELECT DISTINCT id, list_aggregate(words[i : least(i + 4, len(words))], 'string_agg', ' ') AS shingle
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
        FROM (SELECT id, list_filter(string_split_regex(lower(text), '[ \t\n\r\v\f]+'), lambda w: w <> '') AS words
              FROM ({source})) WHERE len(words) > 0)
"""


@query(f"""
WITH d AS ({_SHINGLES_SQL.format(source="SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")}),
     b AS ({_SHINGLES_SQL.format(source="SELECT item_id AS id, coalesce(text, '') AS text FROM benchmark")}),
     n AS (SELECT id, count(*) AS item_shingles FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / CAST(any_value(n.item_shingles) AS DOUBLE) AS containment,
       any_value(n.item_shingles) AS item_shingles
FROM d JOIN b ON d.shingle = b.shingle JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.item_shingles)
""")
def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op1_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base, kinds = spans.base_only(F.col("spans")), secrets.KINDS
    said = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("bigint")
    return found.select(
        "doc_id",
        *[spans.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(spans.joined(base, kinds), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), kinds).alias("spans"),
        said("owned").alias("n_owned"),
        said("copied").alias("n_copied"),
    )


@query()
def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base, kinds = spans.base_only(F.col("spans")), pii.KINDS
    return found.select(
        "doc_id",
        *[spans.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(spans.joined(base, kinds), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), kinds).alias("spans"),
    )


@query()
def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"))


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"))))


@query(r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\v\f]+'), lambda w: w <> '') AS w
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, doc_id,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
walked AS (
  SELECT part, filter_order, step, any_value(filter) AS filter,
         sum(n) FILTER (mask & (coalesce(earlier, 0)::INT | bit) = 0) AS kept,
         sum(n) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit > 0) AS removed,
         sum(n) FILTER (mask & coalesce(earlier, 0)::INT > 0 AND mask & bit > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit > 0) AS good_lost,
         sum(toxic) FILTER (mask & coalesce(earlier, 0)::INT = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM walked
""")
def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    # Null where the exact number is beyond 64 bits.
    deviation = F.col("deviation").try_cast("bigint")
    return found.withColumn("deviation", deviation).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
