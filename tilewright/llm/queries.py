"""Queries over tags, names and documents, with their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import encode, frequency, leaks, lookalike, repetition
from tilewright.session import table

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word run of this length is a leak.
LEAK_WORDS = 10
#: A text is repetitive if this share (as tenths) of its windows of five words repeat an earlier one.
WINDOW, REPEATED_TENTHS = 5, 3


def _terms(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "tags").where("key is not null")
    key = F.struct(F.lit("key").alias("scope"), F.col("key").alias("tag_key"), F.lit("").alias("tag_value"))
    pair = F.struct(F.lit("pair").alias("scope"), F.col("key").alias("tag_key"), F.col("value").cast("string").alias("tag_value"))
    is_pair = (F.col("type") == 0) & F.col("value").isNotNull()
    return tags.select("feature_id", F.inline(F.when(is_pair, F.array(key, pair)).otherwise(F.array(key))))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and features of every key and every key with value, and the mark."""
    counts = frequency.term_counts(_terms(spark, d), "feature_id", ["scope", "tag_key", "tag_value"])
    everything = table(spark, d, "tags").select("feature_id").distinct().agg(F.count("feature_id").alias("n"))
    return frequency.marks(counts, everything.scalar())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counts(spark, d).where("mark is not null").select("scope", "tag_key", "tag_value", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalikes(table(spark, d, "gn_excerpt"), "geonameid", ["name", "alternatenames"])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records by classes of spellings that look the same."""
    return lookalike.look_classes(table(spark, d, "gn_excerpt"), "geonameid", ["name", "alternatenames"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents, the items they hold passages of, and at how many places."""
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", LEAK_WORDS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words, windows, repeated windows and covered words of every document."""
    return repetition.repeated_content(table(spark, d, "documents"), "doc_id", "text", WINDOW).drop("longest")


def p10_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Covered share and longest repeat of every document."""
    got = repetition.repeated_content(table(spark, d, "documents"), "doc_id", "text", WINDOW)
    share = F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0))
    return got.select("doc_id", share.alias("covered_share"), "longest")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    got = repetition.repeated_content(table(spark, d, "documents"), "doc_id", "text", WINDOW)
    return got.where((F.col("n_windows") > 0) & (F.col("n_repeated") * 10 >= F.col("n_windows") * REPEATED_TENTHS)).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_classes, p8_ids, p9_found, p9_leaks, p10_found, p10_shares, p10_repeats)}

_COUNTS = """n AS (SELECT count(DISTINCT feature_id) AS total FROM tags),
terms AS (SELECT feature_id, 'key' AS scope, key AS tag_key, '' AS tag_value FROM tags WHERE key IS NOT NULL
  UNION ALL SELECT feature_id, 'pair', key, decode(value) FROM tags WHERE key IS NOT NULL AND type = 0 AND value IS NOT NULL),
counts AS (SELECT scope, tag_key, tag_value, count(*) AS occurrences, count(DISTINCT feature_id) AS records FROM terms GROUP BY ALL),
marked AS (SELECT counts.*, CASE WHEN records <= 2 THEN 'rare' WHEN records * 4 > total THEN 'common' END AS mark FROM counts, n)"""
# Letters of the two other scripts in the gazetteer and the Latin letters that look like them.
_ALIKE = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορστυ", "ABEZHIKMNOPTYXayiĸvopoᴛu"), ("АВЕЅІЈКМНОРСТУХҮԜаегѕіјкорстухһүѵԁԛԝ", "ABESIJKMHOPCTYXYWaersijĸopcᴛyxhyvdqw")
_FROM, _TO = "".join(a for a, _ in _ALIKE) + "ЀЁЇѐёї", "".join(b for _, b in _ALIKE) + "ÈËÏèëï"
_WIDE_FORMS = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SKELETON = f"""nfc_normalize(translate(translate(nfc_normalize(regexp_replace(regexp_replace(text,
  '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '[\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')),
  '{_WIDE_FORMS[0]}', '{_WIDE_FORMS[1]}'), '{_FROM}', '{_TO}'))"""
_LOOKS = f"""src AS (SELECT DISTINCT 'name' AS field, geonameid AS id, name AS text FROM gn_excerpt WHERE name <> ''
  UNION SELECT 'alternatenames', geonameid, alternatenames FROM gn_excerpt WHERE alternatenames <> ''),
sk AS (SELECT field, id, text, {_SKELETON} AS s FROM src)"""
_WORDS = """w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\\\\[A-Za-z]+', ' ', 'g')), '[\\pL\\pN]+') AS w FROM documents)"""
_RUNS = f"""{_WORDS},
iw AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\\\\[A-Za-z]+', ' ', 'g')), '[\\pL\\pN]+') AS w FROM eval_items),
dr AS (SELECT doc_id, i, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10))"""
_WINDOWS = f"""{_WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM win),
reach AS (SELECT doc_id, i, i - max(CASE WHEN c > 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS back FROM twice),
stat AS (SELECT w.doc_id, any_value(len(w.w)) AS n_words FROM w GROUP BY w.doc_id),
rep AS (SELECT doc_id, count(*) AS n_windows, count(*) - count(DISTINCT run) AS n_repeated FROM win GROUP BY doc_id)"""
SQL = {
    "p1_counts": f"WITH {_COUNTS} SELECT * FROM marked",
    "p1_found": f"WITH {_COUNTS} SELECT scope, tag_key, tag_value, mark FROM marked WHERE mark IS NOT NULL",
    "p3_found": f"""WITH {_LOOKS}
SELECT DISTINCT a.field, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM sk a JOIN sk b ON a.field = b.field AND a.s = b.s AND a.text < b.text AND a.id <> b.id""",
    "p3_classes": f"""WITH {_LOOKS}, c AS (SELECT field, s, min(id) AS class_id, count(DISTINCT text) AS n_spellings, count(DISTINCT id) AS n_records FROM sk GROUP BY field, s)
SELECT DISTINCT field, id, class_id, n_spellings, n_records FROM sk JOIN c USING (field, s) WHERE n_spellings > 1""",
    "p9_leaks": f"WITH {_RUNS} SELECT doc_id, item_id, count(*) AS n_runs FROM dr JOIN ir USING (run) GROUP BY doc_id, item_id",
    "p9_found": f"WITH {_RUNS} SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)",
    "p10_shares": f"""WITH {_WINDOWS},
cov AS (SELECT doc_id, count(DISTINCT p) AS n_covered FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE c > 1) GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_windows, 0) AS n_windows, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_covered, 0) AS n_covered
FROM stat LEFT JOIN rep USING (doc_id) LEFT JOIN cov USING (doc_id)""",
    "p10_found": f"WITH {_WINDOWS} SELECT doc_id FROM rep WHERE n_repeated * 10 >= n_windows * 3",
}
