"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import audio, compression, divergence, kneser_ney, main_text, merkle, near_dup, packing, pieces, pii, quality, repeats, urls
from linkloom.llm._run import Scratch


def vocabulary(name: str) -> bytes:
    """A file of the public tokenizers."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns are those of 400 bytes alone; passages of over 50 words, of any number of bytes, have columns of their own."""
    return repeats.digests(table(spark, sf_dir, "documents"), words=51)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


#: Keys of the planted copies of op10.
COPIES = 10**12


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: each embedding is played as a melody, and those of ids divisible by 100 once more, cut short at the front. Queries: ids divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    prints = audio.fingerprints(vectors, audio.RATE, "vec_id", "embedding", audio.melody)
    again = audio.fingerprints(vectors.filter("vec_id % 100 = 0"), audio.RATE, "vec_id", "embedding", lambda v: audio.melody(v)[8 * audio.HOP :])
    with Scratch(spark) as own:  # what aligned() returns does not read them
        every = own.settle(prints.unionByName(again.withColumn("vec_id", F.col("vec_id") + COPIES)), "fingerprints")
        return audio.aligned(every, every.filter((F.col("vec_id") % 50 == 0) & (F.col("vec_id") < COPIES)), "vec_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the base counts and rules."""
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality.BASE, "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: how many base spans there are."""
    return pii.spans(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op4_urls": urls.oracle,
    "op11_merkle": merkle.oracle,
    "op12_divergence": divergence.oracle,
    # all pairs of different texts that share an element; classes by a recursive walk along links
    "op8_near_dup": lambda: f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS e FROM t),
k AS (SELECT e, min(doc_id) AS k0 FROM g WHERE e IS NOT NULL GROUP BY e), x AS (SELECT k0, len(e) AS n, unnest(e) AS el FROM k),
p AS (SELECT a.k0 AS a, b.k0 AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.el = b.el AND a.k0 <> b.k0 GROUP BY ALL), l AS (SELECT a, b FROM p WHERE c * 5 >= 4 * (na + nb - c)),
r AS (SELECT k0 AS node, k0 AS root FROM k UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a), h AS (SELECT node, min(root) AS class_id FROM r GROUP BY node), d AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT g.doc_id, coalesce(h.class_id, g.doc_id) AS class_id, coalesce(d.n_links, 0) AS n_links FROM g LEFT JOIN k ON g.e = k.e LEFT JOIN h ON h.node = k.k0 LEFT JOIN d ON d.node = k.k0""",
    "quality_base": lambda: rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM v WHERE n > 1) GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "pii_base": lambda: r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: p::HUGEINT > 255)) = 0)) AS n_ip,
len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(x), i, 1)::INT ELSE substr(reverse(x), i, 1)::INT * 2 - CASE WHEN substr(reverse(x), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15)) AS n_phone FROM m""",
}


def queries() -> dict:
    own = [op1_pieces, op2_kneser_ney, op3_quality, op4_urls, op5_pii, op6_packing, op7_repeats, op8_near_dup, op9_main_text, op10_audio, op11_merkle, op12_divergence, op13_compression, quality_base, pii_base]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in SQL.items()}
