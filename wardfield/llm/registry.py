"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, lm, mixing, pieces, quality, rules, setsketch, simhash, spelling, substring, topk, whitening
from .common import fold, split_words, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Production parameters of the mixture.
MIXTURE = {"entropy": 0.98, "max_repeats": 4.0}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def hex_of(signed):
    return F.lower(F.lpad(F.hex(signed), 16, "0"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.digests(docs, piece_model())


@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    slim = simhash.near_duplicates(docs).select("doc_id", hex_of("fingerprint").alias("fingerprint"), "component_id")
    return slim


_REPEATS = r"""
WITH split AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM split, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, (SELECT unnest(range(50)) AS j)),
words AS (SELECT doc_id, p, w[p] AS x FROM split, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", _REPEATS)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return substring.kept_digests(table(spark, folder, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    net = language.learn(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs.withColumn("n_tokens", F.size(split_words(F.col("text"))).cast("long")), **MIXTURE)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block")


_TOP = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_topk", _TOP)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top(topk.integers(table(spark, folder, "embeddings")))


_CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
chats AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY conv_id),
rated AS (
  SELECT conv_id, turns, turns[1] AS opening,
    coalesce(list_sum(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: length(t.text))), 0) AS said FROM chats),
best AS (
  SELECT *, row_number() OVER (PARTITION BY opening ORDER BY said DESC, conv_id) AS place FROM rated),
openings AS (
  SELECT 'opening' AS kind, c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.turns AS chosen, r.turns AS rejected
  FROM best c JOIN best r ON c.opening = r.opening AND c.place = 1 AND r.place > 1),
cut AS (
  SELECT conv_id, turns[:last - 1] AS before, turns[last] AS reply FROM (
    SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last FROM chats) WHERE last IS NOT NULL),
stale AS (
  SELECT 'stale' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, list_append(before, reply) AS chosen,
    list_append(before, {'role': reply.role, 'text': coalesce(list_filter(before, lambda t: t.role = 'assistant')[-1].text, before[-1].text, '')})
      AS rejected FROM cut),
pairs AS (SELECT * FROM openings UNION ALL SELECT * FROM stale),
placed AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])),
    greatest(len(chosen), len(rejected)) + 1) - 1 AS prompt_turns FROM pairs),
parts AS (
  SELECT kind, chosen_id, rejected_id, prompt_turns, chosen[:prompt_turns] AS p, chosen[prompt_turns + 1:] AS c,
    rejected[prompt_turns + 1:] AS r FROM placed WHERE prompt_turns < greatest(len(chosen), len(rejected)))
SELECT kind, chosen_id, rejected_id, CAST(prompt_turns AS INTEGER) AS prompt_turns,
""" + ",\n".join(
    f"array_to_string(list_transform({c}, lambda t: concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10))), '') AS {name}"
    for c, name in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))) + ",\n" + ",\n".join(
    f"array_to_string(list_transform({c}, lambda t: concat('-', length(t.role) + 5, ' ', CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END, "
    f"length(t.text) + 8)), ' ') AS {name}" for c, name in (("c", "chosen_mask"), ("r", "rejected_mask"))) + " FROM parts"


@query("op7_chat", _CHAT)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_all(table(spark, folder, "conversations"))


@query("op3_lm_score")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), fold(F.col("doc_id"), 5) == 1)


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


_SETS = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""


@query("op11_setsketch", _SETS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


_SPELLING = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b, count(*) AS c FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(b), 2), lambda k: ('0x' || b[k:k + 1])::BIGINT)),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM counted, crc),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS d FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word < b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.d = w.word),
sides AS (SELECT a AS word, b AS near, nb AS c FROM pairs UNION ALL SELECT b, a, na FROM pairs),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(c := -c, near := near)) AS best FROM sides GROUP BY word),
forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.best.c >= 2 * n THEN best.best.near END AS form,
    CASE WHEN -best.best.c >= 2 * n THEN -best.best.c END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.place WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word) USING (word)
"""


@query("op13_spelling", _SPELLING)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
