"""The queries of this subpackage's operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, line_dedup, lm_score, mixing, ngram_join, quality, suffix_dedup, toxicity
from .common import table

#: Weights that the mixing query asks for, by level.
DOMAIN_WEIGHTS = {"d0": 40, "d1": 30, "d2": 20, "d3": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SOURCE_WEIGHTS: dict[str, int] = {}


def with_domain(docs: DataFrame) -> DataFrame:
    """A domain for a source: the number in its name modulo 4, as the tables have no domains of their own."""
    n = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("d"), (n % 4).cast("string")))


#: The public vocabulary with offsets that conversations are encoded with; a parameter of the operator.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(turns.unionByName(extra), TOKENIZER)).drop("n_tokens")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_chat_format": op6_chat_format,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
}

_WS = r"[\x20\x09-\x0D]"

OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS stay FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> stay AS gone FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8_SQL = rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def _weights_sql(given: dict[str, int], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1 END" if given else "1"


def _fill_sql(name: str, source: str, parent: str, node: str) -> str:
    part = f"PARTITION BY {parent} " if parent else ""
    return f"""
{name}_0 AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c0,
    (sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS w0
  FROM {source} WINDOW o AS ({part}ORDER BY cap::DOUBLE / w::DOUBLE, {node})
), {name}_1 AS (SELECT *, cap::HUGEINT * w0 <= (b - c0) * w AS is_full FROM {name}_0),
{name}_2 AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})::HUGEINT AS cf, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part})::HUGEINT AS wf FROM {name}_1
), {name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE ((b - cf) * w) // wf END AS budget FROM {name}_2)"""


OP3_SQL = rf"""
WITH light AS (
  SELECT doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), '') AS BIGINT), 0) % 4 AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * 2)::BIGINT AS cap FROM light GROUP BY ALL HAVING sum(n_tokens) > 0
), n1 AS (
  SELECT domain, sum(cap)::BIGINT AS cap, {_weights_sql(DOMAIN_WEIGHTS, "domain")} AS w, (SELECT (sum(n_tokens) // 2)::HUGEINT FROM light) AS b FROM leaves GROUP BY domain
), {_fill_sql("f1", "n1", "", "domain")},
n2 AS (
  SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, {_weights_sql(LANG_WEIGHTS, "lang")} AS w, max(budget)::HUGEINT AS b FROM leaves l JOIN f1 USING (domain) GROUP BY l.domain, lang
), {_fill_sql("f2", "n2", "domain", "lang")},
n3 AS (
  SELECT domain, lang, source, l.supply, l.cap, 1 AS w, budget::HUGEINT AS b FROM leaves l JOIN (SELECT domain, lang, budget FROM f2) USING (domain, lang)
), {_fill_sql("f3", "n3", "domain, lang", "source")},
plan AS (
  SELECT domain, lang, source, budget::BIGINT AS leaf_budget, (budget // supply)::INT AS whole, (budget % supply)::BIGINT AS rest FROM f3
), ordered AS (
  SELECT light.*, leaf_budget, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('0:' || whole || ':' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM light JOIN plan USING (domain, lang, source)
), chosen AS (
  SELECT *, CASE WHEN upto <= rest AND rest > 0 THEN whole ELSE whole - 1 END AS last_epoch FROM ordered
)
SELECT doc_id, unnest(range(0, last_epoch + 1))::INT AS epoch, domain, lang, source, n_tokens, leaf_budget FROM chosen WHERE last_epoch >= 0
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
w AS (SELECT doc_id, unnest(list_transform(range(0, n - 99), lambda i: {'s': i, 'key': md5_number(substr(x, 2 * i + 1, 200))}), recursive := true) FROM n WHERE n >= 100),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS rn FROM w),
r AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM k WHERE rn > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
p AS (SELECT doc_id, span, min(s) AS lo, max(s) + 100 AS hi FROM g GROUP BY doc_id, span),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next_ FROM p),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed,
    string_agg(substr(x, (2 * from_ + 1)::BIGINT, (2 * (lo - from_))::BIGINT) || CASE WHEN next_ IS NULL THEN substr(x, (2 * hi + 1)::BIGINT) ELSE '' END, '' ORDER BY lo) AS kept
  FROM q JOIN n USING (doc_id) GROUP BY doc_id
)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS head FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(head) + 2 + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS comp FROM r GROUP BY node),
g AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, documents.doc_id) AS component_id,
  CASE WHEN g.h IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY g.h) END AS copies
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.node = documents.doc_id LEFT JOIN g ON g.doc_id = documents.doc_id
"""

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
}
