"""One query per operator, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import (
    byte_pairs,
    debruijn_dedup,
    exact_dedup,
    html_text,
    packing,
    pii,
    piece_tokens,
    resampling,
    simhash_dedup,
    spelling,
    suffix_dedup,
    topk,
    toxicity,
)

#: Surrogates are drawn with this key unless a caller brings a secret one.
PII_KEY = b"spendloom"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def op1_toxicity(spark, sf):
    model = toxicity.train(_docs(spark, sf), _table(spark, sf, "labels"))
    found = toxicity.score(_docs(spark, sf), model)
    return found.withColumn("toxic", F.col("severity") >= 0.5)


def op2_html_text(spark, sf):
    return html_text.extract(_table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op3_best_fit_packing(spark, sf):
    return packing.pack_documents(_docs(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_dedup(spark, sf):
    found = simhash_dedup.near_duplicates(_docs(spark, sf))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_pii_surrogates(spark, sf):
    found = pii.replace_personal_data(_docs(spark, sf).select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.col("pii.kind").alias("kinds"))


def op6_exact_dedup(spark, sf):
    found = exact_dedup.exact_duplicates(_docs(spark, sf), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_debruijn_dedup(spark, sf):
    return debruijn_dedup.remove_repeats(_docs(spark, sf)).drop("spans")


def op8_exact_top_k(spark, sf):
    vectors = topk.weights(_table(spark, sf, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op9_sentencepiece(spark, sf):
    """Ids of each text, and whether decoding them gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_tokens.encode(_docs(spark, sf).select("doc_id", "text"), model)
    found = piece_tokens.decode(found, model, to="back")
    exact = F.col("back") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", "ids", F.size("ids").alias("n_ids"), exact.alias("exact"))


def op10_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(_docs(spark, sf)).drop("spans")


def op11_importance_resampling(spark, sf):
    return resampling.resample(_docs(spark, sf), _table(spark, sf, "benchmark"))


def op12_byte_bpe(spark, sf):
    """Ids of each text and the bytes that they decode to, as digests."""
    model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_pairs.decode(byte_pairs.encode(_docs(spark, sf).select("doc_id", "text"), *model), *model)
    n_tokens = F.floor(F.length("ids") / 4).alias("n_tokens")
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return found.select("doc_id", n_tokens, *digests)


def op13_spelling_variants(spark, sf):
    return spelling.variant_forms(_docs(spark, sf))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WINDOWS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
 FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM
 (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM m, generate_series(0, 12) g(j) WHERE gone),
r AS (SELECT p.doc_id, p.i, word, c.i IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i)
SELECT d.doc_id, len(w) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY ALL"""

_TOP_K = """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
 FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id AS query_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (i) WHERE vec_id <> query_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
QUALIFY rank <= 10"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of UTF-8 bytes in DuckDB, bit by bit."""
    data = f"encode({text})"
    bits = f"list_transform(range(8 * octet_length({data})), lambda i: get_bit({data}::BIT, CAST(i // 8 * 8 + 7 - i % 8 AS INT)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}::BIGINT[]), {step}), 4294967295)"


_RESAMPLING = rf"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS word FROM w),
v AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
b AS MATERIALIZED (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM u UNION SELECT word FROM v)),
s AS (SELECT bucket, count(*) AS s FROM u JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM v JOIN b USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000) /
  ((s + 1)::DOUBLE * ((SELECT count(*) FROM v) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, sum(gain) AS gain FROM u JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE (gain - ((gain % len(w)) + len(w)) % len(w)) // len(w) END AS BIGINT) AS weight,
 CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT)::DOUBLE AS h FROM w LEFT JOIN m USING (r)),
y AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20
 QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM y LEFT JOIN z USING (r)"""

_SPELLING = rf"""WITH RECURSIVE u AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS word FROM documents),
h AS MATERIALIZED (SELECT word, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word")} AS h FROM
 (SELECT doc_id, word, count(*) AS n FROM u WHERE length(word) >= 7 GROUP BY ALL)),
c AS MATERIALIZED (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
  THEN substr(word, 1, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) + 2 AS INT)) ELSE word END AS w FROM h)
 WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
 FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM c)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
 UNION SELECT d.word, c.word, c.n FROM d JOIN c ON d.cut = c.word UNION SELECT c.word, d.word, d.n FROM d JOIN c ON d.cut = c.word),
f AS MATERIALIZED (SELECT c.word, c.n, count(near) AS n_near, max(near_n) AS top, min_by(near, (-near_n, near)) AS best FROM c LEFT JOIN p USING (word) GROUP BY ALL),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM f),
r AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT r.word, g.form, step + 1 FROM r JOIN g ON r.root = g.word WHERE g.form IS NOT NULL),
e AS (SELECT word, max_by(root, step) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN e USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_importance_resampling": _RESAMPLING,
        "op13_spelling_variants": _SPELLING,
        "op7_debruijn_dedup": _WINDOWS,
        "op8_exact_top_k": _TOP_K,
        "op6_exact_dedup": f"""WITH t AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
 sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)""",
    }
