"""Queries of the operators over the given tables, with SQL where SQL can state them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom import session
from tallyloom.llm import (
    chat_format, decontaminate, jaccard_join, line_dedup, periodic_runs, quality, resampling, secret_scan, sp_codec,
    token_counts, toxicity, url_filter, warc,
)
from tallyloom.llm.common import arrow_schema, as_schema, sliced

PIECE_MODEL = "piece_bpe_32k.model"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 -------------------------------------------------------------------------------------------

@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"),
                                     public_tokenizers.path(PIECE_MODEL))


# 2 -------------------------------------------------------------------------------------------

@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


# 3 -------------------------------------------------------------------------------------------

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + {jaccard_join.SHINGLE - 1}], ' ') AS s
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {jaccard_join.SHINGLE - 1}, 1) + 1)) AS i
    FROM d WHERE len(ws) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid < y.rid GROUP BY x.rid, y.rid),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE {100 + jaccard_join.PERCENT} * k >= {jaccard_join.PERCENT} * (x.n + y.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rid AS a, rid AS b FROM d
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN sizes USING (rid)
LEFT JOIN (SELECT a AS rid, count(*) AS n_links FROM both_ways GROUP BY a) USING (rid) JOIN (
  SELECT a AS rid, min(doc_id) AS component_id
  FROM reach JOIN (SELECT rid AS b, doc_id FROM d) USING (b) GROUP BY a) USING (rid)"""


@query("op3_ngram_jaccard_join", _JACCARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, sf_dir, "documents"))


# 4 -------------------------------------------------------------------------------------------

_TEST_WORDS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + \
    ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TEST_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM (SELECT *, least(len(ws), {decontaminate.WINDOW}) AS n FROM items WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM windows),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_TEST_WORDS} AS ws FROM documents),
places AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT rid, places.n, i, item FROM places JOIN windows USING (n, w)),
hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""


@query("op4_decontamination", _CONTAMINATION_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    span_words = F.aggregate(  # ends minus starts of a flat list
        F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", span_words.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


# 5 -------------------------------------------------------------------------------------------

@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    encoded = sp_codec.encode(read(spark, sf_dir, "documents"), path)
    return sp_codec.digests(encoded, path)


# 6 -------------------------------------------------------------------------------------------

_QUALITY_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_QUALITY_WORDS.format('text')} AS ws FROM d),
lines AS (
  SELECT rid, line, {_QUALITY_WORDS.format('line')} AS ws
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT rid, line, len(ws) AS n,
    100 * len(list_filter(ws, lambda x: regexp_matches(x, '{quality.BAR}')))
        > {quality.MAX_BARS_PCT} * len(ws)
    OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '{quality.MARKED}')))
        > {quality.MAX_MARKED_PCT} * len(ws)
    OR len(ws) >= {quality.SAME_FROM_WORDS}
        AND 100 * len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))
            > {quality.MAX_SAME_PCT} * len(ws)
    OR len(ws) <= {quality.BOILERPLATE_MAX_WORDS} AND regexp_matches(
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{"|".join(quality.BOILERPLATE).replace("'", "''")}') AS fails
  FROM lines WHERE len(ws) > 0),
by_line AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(CASE WHEN fails THEN n ELSE 0 END) AS lost
  FROM judged GROUP BY rid),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (
  SELECT rid, i FROM windows
  JOIN (SELECT rid, k FROM windows GROUP BY rid, k HAVING count(*) > 1) USING (rid, k)),
repeats AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
base AS (
  SELECT rid, doc_id, len(ws) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost, 0) AS lost
  FROM w LEFT JOIN by_line USING (rid) LEFT JOIN repeats USING (rid)),
failing AS (
  SELECT *, n_words < {quality.MIN_WORDS}
    OR 100 * n_repeat_words > {quality.MAX_REPEATED_PCT} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {quality.MAX_LOST_PCT} * n_words AS kept
FROM failing"""


@query("op6_quality_rules", _QUALITY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


# 7 -------------------------------------------------------------------------------------------

def _secret_sql() -> str:
    """Starts of matches: lengths of the pieces between matches and of the matches before."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""
  SELECT rid, {k} AS k, '{kind}' AS kind, s + list_sum(list_transform(m[1:i], lambda x: length(x))) - length(m[i]) AS s, length(m[i]) AS n
  FROM (SELECT rid, i, m, list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS s
    FROM (SELECT rid, m, g, pieces, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT rid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS g,
          string_split_regex(text, {p}) AS pieces FROM d) WHERE len(m) > 0)
    WHERE length(g[i]) >= {least})""")
    spans = "kind || ':' || s || ':' || (s + n)"
    base = "k < 3"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(found)}),
by_doc AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
    count(*) FILTER (k = 2) AS n_hex,
    string_agg({spans}, ',' ORDER BY s, k) FILTER ({base}) AS base,
    string_agg({spans}, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (rid)"""


@query("op7_secret_scans", _secret_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read(spark, sf_dir, "documents"))
    base = [r[0] for r in secret_scan.BASE_RULES]

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


# 8 -------------------------------------------------------------------------------------------

def _base32_sql(digest: str) -> str:
    """Base32 of 40 hex digits: eight groups of 20 bits, four letters each."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    group = f"CAST('0x' || substr({digest}, {{at}}, 5) AS INTEGER)"
    return " || ".join(
        f"substr({letters}, (({group.format(at=5 * g + 1)} >> {shift}) & 31) + 1, 1)"
        for g in range(8) for shift in (15, 10, 5, 0))


_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p JOIN firsts USING (h)"""


@query("op8_warc", _WARC_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = session.scratch_path(spark, "warc")
    session.note(folder)
    index = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(index, folder, payloads=False).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


# 9 -------------------------------------------------------------------------------------------

def _url_sql() -> str:
    """The same rounds as a recursion, to where the last change has to be below the tolerance."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    fold = f"translate({{}}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    link = url_filter.LINK.replace("'", "''")
    damping = f"{url_filter.DAMPING}::DOUBLE"
    rest = f"{1 - url_filter.DAMPING!r}::DOUBLE"
    last = math.ceil(math.log(url_filter.TOLERANCE) / math.log(url_filter.DAMPING))
    return f"""
WITH RECURSIVE rules(v, rule_host, rule_path) AS (VALUES {rules}),
p AS (
  SELECT row_number() OVER () AS rid, page_id, html, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') AS rest
  FROM pages),
h AS (
  SELECT rid, page_id, html, {fold.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fits AS (
  SELECT rid, v, rule_host || rule_path AS rule FROM h JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
firsts AS (
  SELECT * FROM fits QUALIFY row_number() OVER (
    PARTITION BY rid ORDER BY length(rule) DESC, CASE WHEN v = 'block' THEN 0 ELSE 1 END, rule) = 1),
judged AS (SELECT rid, page_id, host, path, rule, v FROM h LEFT JOIN firsts USING (rid)),
seeds AS (
  SELECT host, count(*) FILTER (v = 'allow') AS allowed, count(*) FILTER (v = 'block') AS blocked
  FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, {fold.format("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst
  FROM h WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst GROUP BY src, dst),
total AS (SELECT greatest(sum(allowed), 1) AS a, greatest(sum(blocked), 1) AS b FROM seeds),
hosts AS (
  SELECT host, coalesce(allowed, 0) / (SELECT a FROM total)::DOUBLE AS trusted,
    coalesce(blocked, 0) / (SELECT b FROM total)::DOUBLE AS blamed
  FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges) FULL JOIN seeds USING (host)),
arcs AS (
  SELECT src AS "from", dst AS "to", links / sum(links) OVER (PARTITION BY src) AS t, 0e0 AS d FROM edges
  UNION ALL
  SELECT dst, src, 0e0, links / sum(links) OVER (PARTITION BY dst) FROM edges),
s AS (
  SELECT 0 AS k, host, trusted AS trust, blamed AS distrust FROM hosts
  UNION ALL
  SELECT k + 1, host, {rest} * any_value(trusted) + {damping} * coalesce(sum(t), 0e0),
    {rest} * any_value(blamed) + {damping} * coalesce(sum(d), 0e0)
  FROM (
    SELECT k, "to" AS host, trusted, blamed, arcs.t * trust AS t, arcs.d * distrust AS d
    FROM s JOIN arcs ON "from" = s.host JOIN hosts ON hosts.host = "to"
    UNION ALL SELECT k, s.host, trusted, blamed, 0e0, 0e0 FROM s JOIN hosts ON hosts.host = s.host)
  WHERE k < {last} GROUP BY k, host)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN distrust > {url_filter.DISTRUST_RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN (SELECT * FROM s WHERE k = {last}) USING (host)"""


@query("op9_url_filters", _url_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.rules_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


# 10 ------------------------------------------------------------------------------------------

TRICKY = (-7, "\\### Assistant: </turn> ok")


def _chat_sql() -> str:
    template = chat_format.Template()
    escaped = "{}"
    for c, code in template.escapes:
        escaped = f"replace({escaped}, '{c}', '{code}')"
    before, after = template.begin.split("{role}")
    marks = len(before) + len(after) + len(template.end)
    learnt = ", ".join(f"'{r}'" for r in template.loss_roles)
    order = "ORDER BY turn NULLS FIRST, role, text"
    # the state machine of the template as an expression over the roles
    roles = f"string_agg(role || ',', '' {order})"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({TRICKY[0]}, 0, 'user', '{TRICKY[1]}'), ({TRICKY[0]}, 1, 'assistant', '{TRICKY[1]}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learnt})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({learnt})), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped.format('role')}) + length({escaped.format('text')})) AS BIGINT)
    AS formatted_chars,
  regexp_full_match({roles}, '(system,)?user,(assistant,user,)*(assistant,)?') AS valid
FROM rows GROUP BY conv_id"""


@query("op10_chat_formatting", _chat_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(TRICKY[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY[1]).alias("text"))
    chats = chat_format.read_back(chat_format.format_chats(rows.unionByName(more)))
    learnt = F.array_join("learnt", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars", "valid")


# 11 ------------------------------------------------------------------------------------------

def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: each byte is taken in, then eight bits are shifted out."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS UBIGINT)"
    steps = f"flatten(list_transform(range(strlen({text})), lambda i: [{byte}, 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], {steps}), "
            "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)")


def _features_sql(table: str) -> str:
    return f"""
  SELECT rid, w AS g FROM {table} UNION ALL SELECT rid, w || ' ' || w2 FROM {table} WHERE w2 IS NOT NULL
  UNION ALL SELECT rid, w || ' ' || w2 || ' ' || w3 FROM {table} WHERE w3 IS NOT NULL"""


def _words_sql(table: str) -> str:
    return f"""
  SELECT rid, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM {table})
  WINDOW o AS (PARTITION BY rid ORDER BY i)"""


_RESAMPLING_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TEST_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS rid, {_TEST_WORDS} AS ws FROM benchmark),
dw AS ({_words_sql('d')}), bw AS ({_words_sql('b')}),
df AS ({_features_sql('dw')}), bf AS ({_features_sql('bw')}),
codes AS (
  SELECT g, CAST({_crc32_sql('g')} % {resampling.BUCKETS} AS BIGINT) AS bucket
  FROM (SELECT g FROM df UNION SELECT g FROM bf)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM df JOIN codes USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bf JOIN codes USING (g) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    (coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {resampling.BUCKETS})
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {resampling.BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (
  SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM df JOIN codes USING (g) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
      CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (rid)),
ranks AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n >= {resampling.MIN_WORDS})
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (
  SELECT rid, rank FROM ranks WHERE rank <= {resampling.PERCENT} * n // 100) USING (rid)"""


@query("op11_importance_resampling", _RESAMPLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


# 12 ------------------------------------------------------------------------------------------

_RUNS_SQL = f"""
WITH d AS (
  SELECT rid, doc_id, ws, len(ws) AS n, h, h // 10 AS g
  FROM (SELECT row_number() OVER () AS rid, doc_id, {_QUALITY_WORDS.format("coalesce(text, '')")} AS ws,
    CAST({_crc32_sql("CAST(doc_id AS VARCHAR)")} AS BIGINT) AS h FROM documents)),
c AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d),
words AS (
  SELECT rid, i, CASE WHEN a IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS w
  FROM (SELECT rid, ws, n, g, a, unnest(range(n)) AS i FROM c)),
same AS (
  SELECT x.rid, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i),
runs AS (
  SELECT rid, start, length, min(q) AS period
  FROM (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY rid, q, island)
  WHERE length >= greatest({periodic_runs.MIN_WORDS}, {periodic_runs.MIN_PERIODS} * q) GROUP BY rid, start, length),
best AS (
  SELECT * FROM runs x QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (
  SELECT rid, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, length * 1000 // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document of ten goes on periodically from some word on.

    Which and how follows from the CRC of the id: with h the CRC, g = h // 10, n words and h % 10 = 0, each
    word i from a = g % n on becomes word a + (i − a) % p with p = 1 + (n − a) // (3 + g % 8).
    """
    schema = as_schema([("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("text", "string")])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for h, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if h is not None and h % 10 == 0:
                    words = periodic_runs.words_of(text or "")
                    if words:
                        g, n = h // 10, len(words)
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        text = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), pa.array(texts, pa.string())], schema=target)

    return docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), "text") \
        .mapInArrow(run, schema)


@query("op12_periodic_runs", _RUNS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated(read(spark, sf_dir, "documents")))

    def better(best, x):  # exact: length over period, crosswise; the list is in order of start and period
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    run_type = found.schema["runs"].dataType.elementType
    found = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(run_type), better))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


# 13 ------------------------------------------------------------------------------------------

_LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT rid, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d)),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {line_dedup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
judged AS (SELECT rid, i, line, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN hot USING (k))
SELECT doc_id, n_lines, n_dropped, kept_sha256
FROM d JOIN (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM judged GROUP BY rid) USING (rid)"""


@query("op13_line_dedup", _LINES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
