"""The queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read, stash


def _held_out(parts: int, one: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is one; rows without an id are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == one, F.lit(False))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.media import media_of_texts

    return media_of_texts(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.mixing import plan

    out = plan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.decontam import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.langid import learn, predict

    docs = read(spark, sf_dir, "documents")
    held_out = _held_out(5, 0)
    model = learn(docs.select("doc_id", "text", "lang"), ~held_out)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.toxicity import learn, score

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _held_out(3, 1)
    model = learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.warc import read_archives, write_archives

    archives = stash(write_archives(read(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"), shards=40)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.html_extract import extract

    return extract(read(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.jaccard import jaccard_classes

    return jaccard_classes(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.secrets import scan

    return scan(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_html_extraction": op8_html_extraction,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_secrets": op10_secrets,
}

_UPPER = "".join(map(chr, range(65, 91)))

ORACLES: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id IS NOT NULL THEN MIN(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to, TRUE AS complete FROM f""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, COALESCE(MAX(n.n), 0) AS n_shingles, MIN(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1""",
}
