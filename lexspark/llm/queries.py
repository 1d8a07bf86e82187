"""One query per operator, over its whole table and with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import chat_format, embedding_dedup, exact_dedup, hmm_scoring, mixing, near_dedup, packing, periodic_runs, sentence_pieces, substring_dedup, token_counts, toxicity, whitening
from lexspark.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, delete the toxic ones, revise the counts of one version, and replay the load."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scratch = Scratch(spark, "token-state")
    ledger = token_counts.TokenLedger(spark, f"{scratch.root}/ledger")
    words = token_counts.count_words(docs, "words@1", WORD)
    pieces = token_counts.count_pieces(docs, "byte_bpe_50k@1", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    state = scratch.save(words.unionByName(pieces), "state")
    ledger.commit("load", inserts=state)
    gone = labels.filter("toxic = 1").select("doc_id").distinct()
    ledger.commit("delete-toxic", deletes=state.join(gone, "doc_id", "left_semi"))
    left = state.join(gone, "doc_id", "left_anti").filter("tokenizer = 'words@1'")
    revised = token_counts.count_words(docs, "words@2", r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]").join(gone, "doc_id", "left_anti")
    ledger.commit("revise-words", revised=(left, revised))
    ledger.commit("load", inserts=state)  # a replay: counted once
    return ledger.totals()


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by a checksum of its id, goes on with its first p words from word a on; without an id none does."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    a = g % n
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"), repeated_words)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_substring_dedup, op3_exact_dedup, op4_token_counts, op5_embedding_dedup, op6_toxicity, op7_minhash_dedup, op8_lm_scoring, op9_source_mixing, op10_sentencepiece, op11_periodic_runs, op12_best_fit_packing, op13_embedding_whitening, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY k) AS turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS chat FROM o GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n, count(*) AS n_copies, turns, min(chat) AS chat FROM c GROUP BY n, turns)
SELECT conv_id, n AS n_turns, n_copies, chat FROM u
WHERE NOT EXISTS (SELECT 1 FROM u AS v WHERE v.n > u.n AND list_slice(v.turns, 1, u.n) = u.turns)
""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT win.doc_id, win.i + k AS p FROM win JOIN f USING (s), (SELECT unnest(range(0, 50)) AS k) WHERE f.m < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op7_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_periodic_runs": r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) AS r FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, xor(r, 4294967295) AS h, xor(r, 4294967295) // 10 AS g FROM c),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
d AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) AS w FROM p),
word AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM d),
eq AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM (
  SELECT u.doc_id, v.i - u.i AS q, u.i FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM eq GROUP BY doc_id, q, isle) WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
best AS (SELECT doc_id, count(*) AS n, min(struct_pack(a := -len, b := s, c := q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(best.n, 0)::BIGINT AS n_runs, b.b::BIGINT AS start, (-b.a)::BIGINT AS length, b.c::BIGINT AS period, (1000 * -b.a // b.c)::BIGINT AS exponent_milli,
  sha256(coalesce(best.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
