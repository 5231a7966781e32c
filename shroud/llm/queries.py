"""The registered queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import decontam, embed, extract, langid, lexical, minhash, packing, pieces, quality, runs, toxicity, urls, warc
from shroud.llm.common import remainder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary() -> str:
    """The file of the tokeniser that the packed ids belong to."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


#: FIXED VALUES: the rules of the query (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits", "quoted")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.trained(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def piece_model() -> str:
    """The SentencePiece model that is encoded with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: FIXED VALUES: one document in ten (by crc32 of its id) repeats its words from a place on, with a period.
PERIODIC = """
  CASE WHEN h % 10 = 0 AND size(w) > 0 THEN
    array_join(transform(w, (x, i) -> element_at(w, CAST(1 + if(i < a, i, a + (i - a) % (1 + (size(w) - a) div (3 + g % 8))) AS INT))), ' ')
  ELSE text END"""


def periodic_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repetitions that the query searches for."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    named = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    worded = named.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    return worded.withColumn("a", F.expr("if(size(w) > 0, g % size(w), 0)")).select("doc_id", F.expr(PERIODIC).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic(periodic_texts(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_decontam": op3_decontam,
    "op4_packing": op4_packing,
    "op5_embeddings": op5_embeddings,
    "op6_urls": op6_urls,
    "op7_toxicity": op7_toxicity,
    "op8_extract": op8_extract,
    "op9_warc": op9_warc,
    "op10_langid": op10_langid,
    "op11_pieces": op11_pieces,
    "op12_runs": op12_runs,
    "op13_lexical": op13_lexical,
}

#: DuckDB SQL. Fitted models, tokenisers, random walks and page extraction can't be expressed in SQL: tests/llm
#: compares those queries with brute force, exact round trips or held-out labels.
ORACLE: dict[str, str] = {
    "op2_minhash": r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS s FROM worded),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM worded UNION SELECT node, v FROM reach JOIN links ON u = seen),
named AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM worded LEFT JOIN sizes USING (doc_id) JOIN named ON node = doc_id""",
    "op5_embeddings": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT node, w FROM reach JOIN links ON u = seen),
named AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN counted ON u = vec_id JOIN named ON node = vec_id""",
    "op6_urls": """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, '.' || host AS h, CASE
  WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM split),
hits AS (SELECT page_id, host, path, rule, list_filter([{terms}], lambda t: contains(' ' || regexp_replace(lower(host || path), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' ' || t || ' ')) AS found FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN list_has_any(found, [{strict}]) OR len(found) >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  array_to_string(found, ' ') AS terms
FROM hits""".replace("{terms}", ", ".join(f"'{t}'" for t in sorted({*urls.STRICT, *urls.SOFT}))).replace("{strict}", ", ".join(f"'{t}'" for t in urls.STRICT)),
    "op9_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> p.page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
    "op13_lexical": r"""
WITH worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{sep}'), lambda t: t <> '') AS t FROM documents),
wanted AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{sep}'), lambda t: t <> '')) AS term FROM benchmark),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM worded WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT r, doc_id, len(t) AS n, u.term AS term, count(*) AS tf FROM worded, unnest(t) AS u(term) WHERE u.term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS c FROM tf JOIN weight USING (term), whole),
scored AS (SELECT item_id, r, doc_id, CAST(sum(c) AS BIGINT) AS score FROM wanted JOIN part USING (term) GROUP BY ALL HAVING sum(c) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= 50""".replace("{upper}", lexical.UPPER).replace("{lower}", lexical.LOWER).replace("{sep}", lexical.SEPARATORS),
}
