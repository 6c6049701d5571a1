"""The registered queries of the text operators: thin reads of whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id, w.doc_id = min(reach.b) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import report

    return report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_OP4_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{_OP4_WORDS}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{_OP4_WORDS}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS g FROM b),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM d, sizes WHERE len(ws) >= n),
occ AS (SELECT doc_id, p, win.n, item FROM spots JOIN win ON spots.n = win.n AND spots.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id),
hw AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS w FROM occ),
isl AS (SELECT doc_id, min(w) - 1 AS a, max(w) AS b FROM (SELECT doc_id, w, w - row_number() OVER (PARTITION BY doc_id ORDER BY w) AS g FROM hw) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS hit_spans FROM isl GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(range(0, len(ws))) AS p, unnest(ws) AS w FROM d),
bt AS (SELECT row_number() OVER () AS r, ws FROM (SELECT DISTINCT ws FROM b)),
bw AS (SELECT r, unnest(range(0, len(ws))) AS q, unnest(ws) AS w FROM bt),
eq AS (SELECT doc_id, r, p - q AS diag, p FROM dw JOIN bw USING (w)),
run AS (SELECT doc_id, min(p) AS a, count(*) AS m FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, r, diag ORDER BY p) AS g FROM eq) GROUP BY doc_id, r, diag, g),
best AS (SELECT doc_id, max(m) AS longest_match, arg_min(a, (-m, a)) AS longest_start FROM run GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest_match, 0) AS longest_match, coalesce(longest_start, -1) AS longest_start, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import predictions

    return predictions(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import predictions

    return predictions(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import report

    return report(_documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import format_conversations, read_back

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return read_back(format_conversations(rows.unionByName(hard)))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, CASE WHEN NOT contains(text, '</turn>') AND NOT contains(text, '### ') THEN text
    WHEN NOT contains(text, '\e') AND NOT contains(text, '\h') THEN replace(replace(text, '</turn>', '\e'), '### ', '\h')
    ELSE replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') END AS body,
  replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), chr(10), '\n') AS name FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(name) + length(body) + 15)::BIGINT AS formatted_chars, true AS round_trip
FROM l GROUP BY conv_id
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.linededup import report

    return report(_documents(spark, sf_dir))


_OP5_WORD = r"[^\x20\x09-\x0D]"
OP5_SQL = rf"""
WITH l0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '{_OP5_WORD}+')) AS n, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM l0 WHERE regexp_matches(t, '{_OP5_WORD}')),
x AS (SELECT *, row_number() OVER o AS k, coalesce(lag(h, 1) OVER o, 0) AS h1, coalesce(lag(h, 2) OVER o, 0) AS h2, coalesce(lag(h, 3) OVER o, 0) AS h3, lead(h) OVER o AS following, lead(h, 2) OVER o AS then_, sum(n) OVER o AS c
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, ((((h3 * 1000003 % 2147483647 + h2) * 1000003 % 2147483647 + h1) * 1000003 % 2147483647 + h) % 2147483647 < 536870911 OR (k > 1 AND h = h1) OR coalesce(following = then_, false)) AND h IS DISTINCT FROM following AS cut FROM x),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
chunks AS (SELECT doc_id, 0 AS kind, min(i) AS s, max(i) AS e, list(t ORDER BY k) AS key FROM g GROUP BY doc_id, chunk HAVING count(*) >= 2),
ahead AS (SELECT a.doc_id, a.k AS k0, min(b.k) AS k1 FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 50 AND b.c - a.c + a.n > 50 GROUP BY a.doc_id, a.k),
back AS (SELECT a.doc_id, max(b.k) AS k0, a.k AS k1 FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 50 AND a.k AND a.c - b.c + b.n > 50 GROUP BY a.doc_id, a.k),
windows AS (SELECT p.doc_id, 1 AS kind, min(i) AS s, max(i) AS e, list(t ORDER BY k) AS key FROM (SELECT * FROM ahead UNION SELECT * FROM back) p JOIN x ON x.doc_id = p.doc_id AND x.k BETWEEN k0 AND k1 GROUP BY p.doc_id, k0, k1),
units AS (SELECT * FROM chunks UNION ALL SELECT * FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY doc_id, s) > 1 AS again FROM units) WHERE again)
SELECT l0.doc_id, count(gone.i) AS n_removed, coalesce(length(string_agg(t, chr(10) ORDER BY l0.i) FILTER (gone.i IS NULL)), 0)::BIGINT AS n_chars,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY l0.i) FILTER (gone.i IS NULL), '')) AS text_sha256
FROM l0 LEFT JOIN gone USING (doc_id, i) GROUP BY l0.doc_id
"""


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator for passages of more than 50 words alone."""
    from tessera.llm.linededup import report

    return report(_documents(spark, sf_dir), chunks=False)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import predictions

    return predictions(_documents(spark, sf_dir))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import report

    return report(_documents(spark, sf_dir))


def op8_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the streams SQL can say: the payloads that are read back from them."""
    return op8_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


OP8_PAYLOAD_SQL = r"""
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT *, greatest(1, (n + 575) // 576) * 576 AS size FROM n)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(b || repeat('\xFF'::BLOB, size - n)) AS payload_sha256 FROM p
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import report

    return report(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vectors import report

    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op11_round(k: int) -> str:
    """Codebooks e<k + 1> from e<k>: assigned, then the floors of the means."""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    return f"""
n{k} AS (SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT r, parts.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS dist FROM parts JOIN e{k} ON parts.p = e{k}.p) GROUP BY r, p),
m{k} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, ({floor})::BIGINT AS x FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS x FROM parts JOIN n{k} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
e{k + 1} AS (SELECT p, e, coalesce(m{k}.c, e{k}.c) AS c FROM e{k} LEFT JOIN m{k} USING (p, e)),"""


OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))),
parts AS (SELECT r, p, list_transform(embedding[p * len(embedding) // 16 + 1:(p + 1) * len(embedding) // 16], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM kept, range(16) AS t(p)),
e0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),{_op11_round(0)}{_op11_round(1)}
last AS (SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT r, parts.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS dist FROM parts JOIN e2 ON parts.p = e2.p) GROUP BY r, p),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e2),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM last GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


def op12_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokens import report

    return report(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_OP13_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {LOWER}), '{_OP13_TERM}') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, {LOWER}), '{_OP13_TERM}')) AS w FROM benchmark),
t AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, n, w),
f AS (SELECT w, floor(1000 * ln((2 * (SELECT nn FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t GROUP BY w),
i AS (SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS impact FROM t JOIN f USING (w), s),
r AS (SELECT item_id, text, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (w) GROUP BY item_id, text, doc_id HAVING sum(impact) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r) WHERE rank <= 10
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    found = {name: globals().get(f"{name.split('_')[0].upper()}_SQL") for name in queries()}
    found["op8_payload"] = OP8_PAYLOAD_SQL
    found["op5_passage_dedup"] = OP5_SQL.replace("SELECT * FROM chunks UNION ALL ", "")
    return {name: sql for name, sql in found.items() if sql}
