"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import bpe, chat, decontam, kernel, langid, linededup, neardup, pii, search, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    # The bounded sample is drawn from the labels, so that few documents are joined.
    labels = kernel.sampled(_table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 5) != 0), ["doc_id", "toxic"], 4000)
    model = toxicity.fit(labels.join(docs, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(rows.where(fold("doc_id", 4) != 2))
    return langid.identify(rows, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents", "doc_id", "text"))
    rank = F.array(*(F.lit(k) for k in pii.KINDS))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(rank, s["kind"]).alias("k"), s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars_kept"), "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.quantise(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return search.top_k(vectors, vectors.where("vec_id % 20 = 0")).drop("share_read")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.read_back(chat.format_conversations(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionAll(own)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id d, doc_id e FROM n UNION SELECT r.d, l.y FROM r JOIN l ON l.x = r.e)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(m, w.doc_id) component_id, coalesce(m, w.doc_id) = w.doc_id kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d doc_id, min(e) m FROM r GROUP BY d) USING (doc_id)
"""

OP4_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(ls) s, generate_subscripts(ls, 1) - 1 k FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents)),
s AS (SELECT doc_id, k, s, trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) t FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) r, len(list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '')) w FROM s WHERE t <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY r) e FROM n),
runs AS (
  SELECT a.doc_id, a.r i, min(b.r) j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.e - a.e + a.w >= 50 GROUP BY ALL
  UNION SELECT a.doc_id, max(b.r), a.r FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.r <= a.r AND a.e - b.e + b.w >= 50 GROUP BY a.doc_id, a.r),
g AS (SELECT runs.doc_id, i, j, md5(string_agg(t, chr(10) ORDER BY r)) h FROM runs JOIN c ON c.doc_id = runs.doc_id AND r BETWEEN i AND j GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) o FROM g),
x AS (SELECT f.doc_id, min(k) a, max(k) b FROM f JOIN n ON n.doc_id = f.doc_id AND n.r IN (f.i, f.j) WHERE o > 1 GROUP BY f.doc_id, i, j),
gone AS (SELECT DISTINCT s.doc_id, k, t FROM s JOIN x ON s.doc_id = x.doc_id AND k BETWEEN a AND b),
kept AS (SELECT s.doc_id, coalesce(string_agg(s.s, chr(10) ORDER BY s.k) FILTER (gone.k IS NULL), '') text, count(gone.k) FILTER (gone.t <> '') n FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.k = s.k GROUP BY s.doc_id)
SELECT d.doc_id, length(kept.text)::BIGINT n_chars_kept, coalesce(n, 0)::BIGINT n_removed_lines, sha256(kept.text) kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20
"""

OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) tl, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) rl, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) p FROM c)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  sum(tl + CASE WHEN p = role THEN 8 ELSE 9 + 8 + 7 + rl END)::BIGINT formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') s FROM (SELECT *, unnest(generate_series(1, greatest(1, len(ws) - 9))) i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') s FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) i FROM w, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(v, ',' ORDER BY v) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR v FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
}
SQL = {"op1_minhash_dedup": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_topk_search": OP5_SQL, "op6_chat_format": OP6_SQL, "op9_decontamination": OP9_SQL}
