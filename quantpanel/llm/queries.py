"""The op queries, with their SQL where SQL can express them. Each applies its operator to its whole table."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm import bm25, chat, exact_dedup, html_text, language_id, line_dedup, ngram_join, packing, sentencepiece_backend, shards
from quantpanel.llm.common import shared_dir

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
ARRIVALS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(d, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.y FROM reach r JOIN edges e ON r.c = e.x)
SELECT r.d AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM reach r LEFT JOIN sizes n ON n.doc_id = r.d GROUP BY r.d
"""


def op3_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, whole; against all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where(F.col("doc_id") % 20 == 0), k=10)


OP3_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM terms GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM len) / (SELECT count(*) FROM documents) AS mean),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(q.tf * ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * d.tf * 2.2E0 / (d.tf + 1.2E0 * (0.25E0 + 0.75E0 * n / mean))), 6) AS score
  FROM tf q JOIN df USING (w) JOIN tf d USING (w) JOIN len ON len.doc_id = d.doc_id, total
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four lots, are compacted and read back from the last manifest."""
    docs = _table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for lot in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS)) == lot))
        store.compact()
        store.vacuum()
    atexit.register(shards.remove_store, store)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, floor(turn / 64.0) AS block,
         replace(replace(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(10), ' '), chr(13), ' ') AS r,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS x FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, r, x) - 1 AS n FROM turns),
speakers AS (SELECT DISTINCT conv_id, r AS speaker FROM turns WHERE r <> 'system'),
pieces AS (
  SELECT t.conv_id, s.speaker, t.block, floor(t.n / 64.0) AS sub, t.n, t.r = s.speaker AS own, t.x,
         '<|im_start|>' || CASE WHEN t.r = 'system' THEN 'system' WHEN t.r = s.speaker THEN 'assistant' ELSE 'user name=' || t.r END || chr(10) AS head
  FROM numbered t JOIN speakers s ON t.conv_id = s.conv_id),
placed AS (
  SELECT *, head || x || '<|im_end|>' || chr(10) AS whole,
         sum(length(head) + length(x) + 11) OVER (PARTITION BY conv_id, speaker, block, sub ORDER BY n) - 11 AS stop FROM pieces)
SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY block, sub) - 1 AS part, count(*) AS n_turns,
       string_agg(whole, '' ORDER BY n) AS text,
       coalesce(string_agg((stop - length(x)) || '-' || stop, ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, block, sub
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only where crc32 of the id as text is not divisible by 5; lang, source and doc_id are no inputs of a prediction."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids again."""
    return sentencepiece_backend.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed
  WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_exact_topk_search,
        op4_sharding,
        op5_chat_formatting,
        op6_language_id,
        op7_sentencepiece,
        op8_html_extraction,
        op9_line_dedup,
        op10_exact_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op3_exact_topk_search": OP3_SQL, "op4_sharding": OP4_SQL, "op5_chat_formatting": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL}
