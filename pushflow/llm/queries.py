"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushflow.llm import ann, decontaminate, minhash, pieces, pii, quality, repeats, score, secrets, warc
from pushflow.llm.common import LOWER, UPPER, table


#: The tokenizer's model file.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and whether decoding gives the text back."""
    model = pieces.load(PIECES)
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    space = F.replace("text", F.lit(pieces.SPACE), F.lit(" "))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(space).alias("round_trip"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scores(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return ann.neighbours(rows, F.col("vec_id") % 100 == 0)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their figures."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back; the reader's rows without the payload."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_minhash": op4_minhash,
    "op5_suffix_array": op5_suffix_array,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 20 bits, as five hexadecimal digits, are four characters.
_DIGEST = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(sha1(coalesce(html, '')), {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))



def _shingles(table: str, key: str, text: str, width: int) -> str:
    """SQL of (row, key, shingle), distinct, of the words of a lower-cased text; one shingle of all words where there are fewer."""
    words = f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    each = f"list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' '))"
    return f"""SELECT row, {key}, unnest(list_distinct(CASE WHEN len(words) >= {width} THEN {each} WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle
        FROM (SELECT row_number() OVER () AS row, {key}, {words} AS words FROM {table})"""


ORACLE_SQL: dict[str, str] = {
    # links on full sets, and the smallest doc_id that can be reached
    "op4_minhash": f"""
        WITH RECURSIVE shingles AS ({_shingles("documents", "doc_id", f"translate(text, '{UPPER}', '{LOWER}')", 3)}),
             sizes AS (SELECT row, doc_id, count(*) AS n FROM shingles GROUP BY ALL),
             shared AS (SELECT a.row AS x, b.row AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row < b.row GROUP BY ALL),
             links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shared s JOIN sizes a ON a.row = s.x JOIN sizes b ON b.row = s.y WHERE 100 * k >= 85 * (a.n + b.n - k)),
             ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
             reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reached r JOIN ends e ON e.x = r.y),
             least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)""",
    "op6_decontaminate": f"""
        WITH held AS ({_shingles("documents", "doc_id", "lower(text)", 5)}),
             asked AS ({_shingles("benchmark", "item_id", "lower(text)", 5)}),
             sizes AS (SELECT row, count(*) AS n_item FROM asked GROUP BY ALL),
             found AS (SELECT h.row AS held_row, doc_id, a.row, item_id, count(*) AS n_shared FROM held h JOIN asked a USING (shingle) GROUP BY ALL)
        SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM found JOIN sizes USING (row) WHERE n_shared * 100 >= n_item * 80 ORDER BY doc_id, item_id, containment DESC, n_item DESC""",
    "op8_warc": f"""
        WITH d AS (SELECT page_id, coalesce(html, '') AS body, {_DIGEST} AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM d)
        SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM f""",
}
