"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, lexical, licenses, mixing, perplexity, prefixtrie, resampling, secrets, urlrules, warc
from .setjoin import jaccard_components
from .simhash import simhash_components

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The conversation that op4 adds: both texts look like the template's own marks.
MARKS = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their n-grams, log weight and whether the resampler keeps them."""
    out = resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_weight", "kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of its source takes."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents by fixed rules and perplexity bands."""
    out = perplexity.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all formatted conversations and the one that looks like the template's marks."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archives of all pages."""
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that all documents hold, with their coverage."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that all documents hold."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts of the base patterns, their digest and all spans."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that link by their shingles."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share first turns."""
    return prefixtrie.prefix_trie(prefixtrie.shared_heads(_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages of corpus_pipeline leave of all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = (op1_importance_resampling, op2_source_mixing, op3_perplexity_rules, op4_chat_format, op5_warc_writer, op6_license_scan, op7_decontamination, op8_url_filter, op9_secret_scan, op10_ngram_jaccard_join, op11_simhash_trie, op12_ranked_search, op13_prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_OPERATORS, pipeline)}


_OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(head) + length(': ') + length(body) + length('</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

_OP8 = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

#: Every pair of documents with a common shingle is counted, which suits small tables only.
_OP10 = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM texts
), windows AS (
  SELECT doc_id, n_words, spot,
    concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS shingle
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM windows WHERE spot <= greatest(n_words - 4, 1)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(shingle) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), component(id, least) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT ways.b, min(c.least) FROM component c JOIN ways ON c.id = ways.a JOIN recurring.component r ON r.id = ways.b WHERE c.least < r.least GROUP BY ways.b
)
SELECT doc_id, n AS n_shingles, least AS component_id FROM sizes JOIN component ON doc_id = id
"""


_OP12 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sums AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d
), tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sums
), q AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), found AS (
  SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(terms) * n) // l)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (r), sums GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM found WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_OP13 = """
WITH turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'digest': digest, 'size': size} ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id
), heads AS (  -- crc32 of the decimal conv_id, bit by bit
  SELECT conv_id, turns, xor(list_reduce(
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[:a.h], []), a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), steps AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt
), member AS MATERIALIZED (
  SELECT conv_id, depth, len(turns) AS n_turns, md5(array_to_string(list_transform(turns[:depth], lambda x: x.digest), '')) AS node, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size FROM steps
), nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n_turns), '')) AS ends_sha256
  FROM member GROUP BY node, depth
), parents AS (
  SELECT n.node, m.node AS parent FROM nodes n JOIN member m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent
), subtree AS (
  SELECT m.node, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (node) JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s USING (node) LEFT JOIN children c USING (node) LEFT JOIN parents USING (node) LEFT JOIN nodes p ON p.node = parents.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": _OP4, "op5_warc_writer": _OP5, "op8_url_filter": _OP8, "op10_ngram_jaccard_join": _OP10, "op12_ranked_search": _OP12, "op13_prefix_trie": _OP13}
