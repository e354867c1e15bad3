"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.llm.bpe import bpe_encode
from cellfold.llm.embed_dedup import embedding_groups
from cellfold.llm.html_text import extract_text
from cellfold.llm.lexical import build_index, search
from cellfold.llm.mixing import mix_sources
from cellfold.llm.multiset import edited_fingerprints
from cellfold.llm.prefix_trie import prefix_trie, rebuilt_conversations
from cellfold.llm.rollup import TokenRollup, deletes, inserts, revisions
from cellfold.llm.shared import cut, fresh_dir
from cellfold.llm.simhash import simhash_groups
from cellfold.llm.toxicity import fit, held_out, score
from cellfold.llm.urlfilter import Rule, filter_urls
from cellfold.llm.warc import warc_roundtrip
from cellfold.llm.wavelet import token_shards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Token patterns of the rollup query, by tokenizer version.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]"}

#: Words with an ASCII letter. A word is tried from its start only, so that a long one takes linear time.
RECOUNT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z]*+[A-Za-z][^\x20\x09-\x0D]*+"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the second of which is sent twice, compacted after the second.

    All documents come in; then "words-1" is recounted without words that lack an
    ASCII letter; then documents of fewer than 20 of those words go.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    worded = {**TOKENIZERS, "recount": RECOUNT}
    # One narrow row per document, so that texts are counted once for all batches.
    text = F.coalesce("text", F.lit(""))
    each = cut(docs.select("source", "lang", *[F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in worded.items()]))
    named = lambda version, n, rows=each: rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(f"`{n}`").alias("n_tokens"), F.col("recount").alias("new_tokens"))
    short = each.where("recount < 20")
    rollup = TokenRollup(spark, fresh_dir(spark, "rollup"))
    rollup.commit("1", inserts(named("words-1", "words-1")), inserts(named("pieces-1", "pieces-1")))
    for _ in range(2):
        rollup.commit("2", revisions(named("words-1", "words-1")))
    rollup.compact()
    rollup.commit("3", deletes(named("words-1", "recount", short)), deletes(named("pieces-1", "pieces-1", short)))
    return rollup.totals()


OP3_SQL = r"""
WITH counts AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]')) AS pieces
  FROM documents
), kept AS (SELECT * FROM counts WHERE words >= 20)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS documents, sum(words)::BIGINT AS tokens FROM kept GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*)::BIGINT, sum(pieces)::BIGINT FROM kept GROUP BY ALL
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_roundtrip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = lambda name: F.expr(f"try_cast(substring_index({name}, ':', -1) as bigint)")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP4_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, strlen(payload) AS bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""

#: A document is rejected from this score on.
TOXIC = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.y, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id
"""

#: The id that ends every document of op7.
END_ID = 1


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_shards(spark, docs, vocabulary("word_bpe_49k.json"), end_id=END_ID)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


#: The rules of the URL query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rules(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (SELECT DISTINCT url FROM pages),
cut AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM urls),
parts AS (
  SELECT url, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM cut),
split AS (
  SELECT url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM parts),
best AS (
  SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM pages JOIN split ON pages.url IS NOT DISTINCT FROM split.url LEFT JOIN best ON best.url = split.url
"""

#: Target weights of the mixing query; other sources have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5, "src4": 0.25}
MIX_SEED = 17


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, seed=MIX_SEED, default_weight=1.0)


OP10_SQL = """
WITH given(source, w) AS (VALUES ('src0', 4.0), ('src1', 3.0), ('src2', 2.0), ('src3', 0.5), ('src4', 0.25)),
counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT c.source, n, coalesce(w, 1.0)::DOUBLE AS w FROM counts c LEFT JOIN given g ON c.source = g.source),
whole AS (SELECT source, w / (SELECT sum(w) FROM weighted) * (SELECT sum(n) FROM weighted)::DOUBLE / n AS rate FROM weighted),
rates AS (SELECT source, ceil(rate / 256)::BIGINT AS parts, rate / ceil(rate / 256) AS rate FROM whole),
drawn AS (
  SELECT d.*, parts, j, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || CASE WHEN j > 0 THEN '|' || j ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(0, parts)) AS p(j)),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 31)::BIGINT)) AS t(k)),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, parts, j, count(s.k) AS copies FROM drawn d LEFT JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, i * parts + j AS copy FROM counted, unnest(range(0, copies)) AS t(i)
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM lengths),
norms AS (SELECT doc_id, 10 + (90 * n * (SELECT N FROM whole)) // (SELECT L FROM whole) AS m FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
weights AS (SELECT item_id, term, floor(1000 * ln((2 * (SELECT N FROM whole) + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term)),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM weights JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))



def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_url_filter": op9_url_filter,
    "op10_source_mixing": op10_source_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_html_extraction": op12_html_extraction,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op3_token_counts": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_source_mixing": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
}
