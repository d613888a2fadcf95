"""The numbered queries over whole tables, with DuckDB texts where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.llm import charlm, chat, covertree, cutting, exthash, mixing, ordermin, phrases, quality, suffixdup, superkmer, tokenfile, warc
from seacast.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: The measures and the verdict of ``quality.BASE`` and ``quality.RULES``.
QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
u AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts
  FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 2 * n_upper > n_letters OR 10 * n_shouts > 3 * n_words AS rule_failed FROM m)
"""


@query(QUALITY_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM b")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    order = quality.by_rejections_per_cost(quality.estimate(docs, quality.BASE + quality.RULES))
    measured = quality.with_measures(docs, _MEASURED)
    judged = quality.quality_cascade(measured, order=order, measured=_MEASURED)
    base = " OR ".join(f"({r.reject})" for r in quality.BASE).format(**{n: n for n in _MEASURED})
    return judged.select("doc_id", *_MEASURED, F.expr(base).alias("base_failed"), "kept")


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query(f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW g AS (PARTITION BY norm)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exthash.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return exthash.one_row_per_key(found.drop("text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Sources are capped in the order of 2 * size / weight; the first one that the level of the uncapped fits sets the level.
MIX_SQL = rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, text,
    md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM {{docs}}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
n AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
p AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, coalesce(sum(2 * source_size) OVER o, 0) AS capped,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM n WINDOW o AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((goal - capped) / weights) AS level FROM p WHERE (goal - capped) / weights * weight <= 2 * source_size AND source_size > 0),
t AS (SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target FROM n, l),
e AS (SELECT z.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(epochs * size + greatest(0, least(CAST(floor(target) AS BIGINT) - epochs * source_size - before, size)) AS BIGINT) AS taken FROM e)
"""


@query(MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, round(target, 6) AS target, taken FROM x")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, list(a) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM u),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g WHERE len(g) = 13),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE f < doc_id),
r AS (SELECT doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN a END, ' ' ORDER BY i) AS kept
  FROM u LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmer.substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdup.suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = tokenfile.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), spaces=True, end_id=0)
    return tokenfile.read_tokens(folder, manifest)


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), spaces=False, end_id=1)


@query()
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


#: Every 97th page's record is damaged in the replica; the audit has to find these and no others.
@query("""
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256,
  page_id % 97 <> 13 AS intact, false AS left_damaged, page_id % 97 = 13 AS right_damaged FROM pages
""")
def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    audit, left, right = warc.audited_archive(spark, pages, F.col("page_id") % 97 == 13)
    audit = stored(audit, "audit")
    good = audit.withColumn("folder", F.when(F.col("left_damaged"), F.lit(right)).otherwise(F.lit(left)))
    payloads = warc.read_records(good).select("page_id", "file", "offset", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("payload_sha256"))
    return payloads.join(audit.select("file", "offset", "intact", "left_damaged", "right_damaged"), ["file", "offset"]).drop("file", "offset")


@query(r"""
WITH r AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS t FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
h AS (SELECT r.*, perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
    ELSE 'user name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\r\n]+', ' ', 'g') END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || t || '<|im_end|>' || chr(10) AS piece FROM h),
o AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, t
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, turn, speaker, piece, start, CASE WHEN speaker = perspective THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN speaker = perspective THEN CAST(start + length(head) + length(t) + 10 AS BIGINT) END AS mask_end FROM o
""")
def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def lloyd_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, each an assignment of all parts to the entries of the round before."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT q.r, q.p, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS err FROM q JOIN b{k} b USING (p)),
a{k} AS (SELECT r, p, e, err FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY err, e) = 1)""")
        if k < rounds:
            mean = ", ".join(f"((sum(q.x[{i}]) - ((sum(q.x[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, width + 1))
            steps.append(f"""
m{k} AS (SELECT p, e, [{mean}] AS x FROM a{k} JOIN q USING (r, p) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, v[{width} * p + 1 : {width} * p + {width}] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, r - 1 AS e, x FROM q WHERE r <= {entries}),{",".join(steps).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h
"""


@query(lloyd_sql())
def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = covertree.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = covertree.with_group_error(stored(coded, "codes")).withColumnRenamed("id", "vec_id")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(covertree.digest(books)).alias("codebooks_sha256"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS s FROM documents),
p AS (SELECT r, lang, unnest(s) AS piece, generate_subscripts(s, 1) AS j FROM d),
w AS (SELECT r, lang, j, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
u AS (SELECT r, lang, j, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r, j ORDER BY i)),
t AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, x AS phrase, 1 AS k FROM g UNION ALL SELECT lang, x || ' ' || y, 2 FROM g WHERE y IS NOT NULL
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3 FROM g WHERE z IS NOT NULL) GROUP BY lang, phrase, k HAVING count(*) >= 10),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, k AS size, w, unnest(range(1, k)) AS k FROM c),
s AS (SELECT x.lang, x.phrase, a, x.size, x.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.a IS NULL OR 100 * m.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000
""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.crc32(F.col("doc_id").cast("string"))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.coalesce(code % 3 == 1, F.lit(False)).alias("held_out"))
    found = charlm.identify(docs, ~F.col("held_out"), F.floor(F.crc32(F.col("doc_id").cast("string")) / 3).cast("long"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
