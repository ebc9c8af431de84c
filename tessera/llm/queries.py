"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontaminate, jaccard, licences, logbilinear, mixing, packing, phrases, quality, revisits, sharding, spans, urlfilter, urls, variants,
)
from tessera.llm.words import configure_for_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn, name: str | None = None, sql: str | None = None):
    name = name or fn.__name__

    def run(spark: SparkSession, folder: str) -> DataFrame:
        configure_for_texts(spark)
        return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
    return fn


def query(sql: str | None = None):
    return lambda fn: _register(fn, sql=sql)


@query(
    sql=f"""
    WITH visits AS (
      SELECT page_id, v AS visit, md5(coalesce(html, '')) AS digest, coalesce(page_id, 0) AS page,
        CASE WHEN v % 2 = 1 AND strpos(url, '?') > 0 THEN url || '&utm_source=crawl'
             WHEN v % 2 = 1 AND strpos(url, '#') > 0 THEN url WHEN v % 2 = 1 THEN url || '#again' ELSE url END AS url
      FROM pages, (SELECT unnest([0, 1, 2, 3]) AS v)
    ), bodies AS (
      SELECT *, greatest(0, CASE WHEN visit >= 1 AND (page * 31 + 17) % 5 = 0 THEN 1 ELSE 0 END,
        CASE WHEN visit >= 2 AND (page * 31 + 34) % 5 = 0 THEN 2 ELSE 0 END,
        CASE WHEN visit >= 3 AND (page * 31 + 51) % 5 = 0 THEN 3 ELSE 0 END) AS body,
        (page * 7 + visit * 3) % 11 AS fault
      FROM visits
    ), records AS (
      SELECT page_id * 4 + visit AS record_id, page % 300 + visit * 30 AS day, body = visit AS full_body, fault, body, digest,
        page % 300 + body * 30 AS modified, {urls.CANONICAL_SQL} AS url_key
      FROM bodies
    ), responses AS (SELECT * FROM records WHERE full_body),
    matched AS (
      SELECT r.record_id, r.url_key, r.day, r.fault, r.body + CASE WHEN r.fault = 0 THEN 9 ELSE 0 END AS tag, r.digest, r.modified,
        max_by(struct_pack(id := p.record_id, body := p.body, digest := p.digest, modified := p.modified, day := p.day),
               p.day * 1000000000000 + p.record_id) AS found
      FROM records r LEFT JOIN responses p
        ON r.url_key = p.url_key AND (p.day < r.day OR p.day = r.day AND p.record_id < r.record_id)
      WHERE NOT r.full_body
      GROUP BY ALL
    ), judged AS (
      SELECT *, CASE WHEN found IS NULL THEN 'no_response'
          WHEN fault < 8 THEN CASE WHEN digest = found.digest AND tag = found.body THEN 'resolved' ELSE 'validator_mismatch' END
          WHEN fault < 10 THEN CASE WHEN modified = found.modified THEN 'resolved' ELSE 'validator_mismatch' END
          ELSE 'resolved_unchecked' END AS status
      FROM matched
    )
    SELECT record_id, url_key, found.id AS response_id, status,
      CASE WHEN status LIKE 'resolved%' THEN
        'content-length: 1' || found.body || '; content-type: text/html; date: day ' || day
        || '; etag: "' || CASE WHEN fault < 8 THEN digest || '-' || tag ELSE found.digest || '-' || found.body END
        || '"; last-modified: day ' || found.modified END AS headers
    FROM judged"""
)
def op1_revisits(table) -> DataFrame:
    """Every revisit of the archive records made from the pages, with its response and merged headers."""
    found = revisits.resolve_revisits(revisits.crawl_records(table("pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "response_id", "status", F.array_join(entries, "; ").alias("headers"))


@query()
def op2_jaccard_join(table) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles link at 0.9."""
    return jaccard.jaccard_groups(table("documents"), size=3, percent=90, pivots="pieces")


@query()
def op3_decontamination(table) -> DataFrame:
    """Benchmark items found in documents, with their edit distance."""
    found = decontaminate.find_leaks(table("documents"), table("benchmark"))
    return found.select("doc_id", "item_id", "distance", "item_bytes")


@query()
def op5_substring_dedup(table) -> DataFrame:
    """Words of repeated 50-word windows removed from every document but the first."""
    return spans.remove_repeated_spans(table("documents"))


@query()
def op6_quality_rules(table) -> DataFrame:
    """Quality verdict of every document; labelled good documents are the trusted target."""
    docs = table("documents")
    trusted = table("labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.fit_ratio(docs, trusted))


@query()
def op7_sharding(table) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    records = table("documents").select(
        "doc_id", F.col("text"), sharding.record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keyed = records.select("doc_id", "size", "text_crc32", sharding.record_key().alias("key"))
    return sharding.shards_of_keys(keyed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# host labels whose pages make the list of blocked URLs
LISTED_LABELS = ("casino", "xxx", "adult", "warez")
LISTED = "^[^/]*(" + "|".join(LISTED_LABELS) + ")"


@query(
    sql=f"""
    WITH parts AS (
      SELECT page_id, {urls.HOST_SQL} AS host, {urls.PATH_SQL} AS path, {urls.CANONICAL_SQL} AS canonical FROM pages
    ), blocked AS (
      SELECT DISTINCT canonical FROM parts WHERE regexp_matches(canonical, '{LISTED}')
    ), ruled AS (
      SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM parts
    )
    SELECT page_id, host, path, rule, rule IS NULL AND b.canonical IS NOT NULL AS listed,
      CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
           WHEN rule IS NOT NULL THEN 'block'
           WHEN b.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled LEFT JOIN blocked b ON ruled.canonical = b.canonical"""
)
def op8_url_filter(table) -> DataFrame:
    """Verdict on every page: the longest rule, else the list of URLs on listed hosts."""
    pages = table("pages")
    listed = pages.select("url").where(urls.canonical(F.col("url")).rlike(LISTED))
    return urlfilter.judge_urls(pages, listed, RULES)


@query(
    sql="""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 24) AS h
      FROM documents
    ), sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight,
        source_size * 3 AS cap
      FROM sources
    ), levels AS (
      SELECT *, cap / weight AS ratio,
        (sum(source_size) OVER ()
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weighed
    ), targets AS (
      SELECT source, source_size,
        CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
             ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target
      FROM levels
    ), placed AS (
      SELECT s.*, t.source_size, t.target,
        sum(size) OVER (PARTITION BY s.source ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS starts_at,
        least(CAST(floor(target / greatest(t.source_size, 1)) AS BIGINT), 3) AS whole
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
      CAST(CASE WHEN size = 0 THEN 0 ELSE
        whole + CASE WHEN whole < 3 AND starts_at + size / 2 < target - whole * source_size THEN 1 ELSE 0 END END * size AS BIGINT) AS taken
    FROM placed"""
)
def op10_mixing(table) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table("documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_log_bilinear(table) -> DataFrame:
    """Log10 probability of every document under the base and the log-bilinear model."""
    return logbilinear.score_texts(table("documents"))


@query()
def op4_license_scan(table) -> DataFrame:
    """Licence paragraphs of all documents with family, probability and the template that confirms it."""
    docs = table("documents")
    return licences.classify(docs, licences.fit(docs))


@query()
def op11_mixture_packing(table) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens that hold the sources' shares."""
    pieces = packing.pack(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "source", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


@query()
def op12_spelling_variants(table) -> DataFrame:
    """Words of five letters and more that occur three times, with the form and root they vary."""
    counted = variants.count_words(table("documents"), least_length=5, drop_every=97)
    return variants.spelling_groups(counted.where("n >= 3"), ratio=2)


@query()
def op13_phrase_collocations(table) -> DataFrame:
    """The first 2000 phrases of two to five words of every language."""
    return phrases.collocations(table("documents"), longest=5, least=100, share=100, top=2000)
