"""Operator 12: how the sources of a language diverge in their terms.

Terms are runs of letters A-Z and characters beyond ASCII, A-Z in lower case. Each batch of texts
is counted by DuckDB's SQL; Spark sums the counts by language, source and term, so that a common
term comes to a shard once a source. Counts are dealt to shards by language and hash of the
term, as many a language as its rows ask for. In each shard SQL keeps the terms of at least
``LEAST`` documents of their language; after the totals are known, SQL in each shard sums the
differences of every pair of sources over the shard's terms and finds the shard's leading terms
of each source. Spark adds the sums and ranks.

A source's share of a term is 1 + floor(1000000000 * (count + 5) / (N + 5 * V)), of V kept terms
of the language with N occurrences in the source. Of a pair of sources only the terms that one
of them has are visited; all others differ by the same amount. All arithmetic is of integers.

Defined results: null text, language and source are empty strings; rows that repeat are documents
of their own; a source without kept terms has pairs, and no terms; a language without kept terms
has pairs of value 0; equal values are ranked by the item's bytes; an empty table gives no rows;
columns that are not named are not read. A task holds some MB of texts (or one text) or one shard.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import _text as tx
from linkloom.llm._run import Scratch

#: Fixed values of the operator.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, TOP, UNIT, SMOOTH = 30, 50, 1_000_000_000, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of counts a shard is meant to have.
SHARD = 1 << 17

_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
COUNTED = f"""SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM (SELECT row, lang, source, term, count(*) AS n FROM
(SELECT row, lang, source, unnest({_WORDS}) AS term FROM texts) GROUP BY ALL) GROUP BY ALL"""
KEPT = f"""SELECT lang, shard, source, term, n, row_number() OVER (PARTITION BY term ORDER BY source) = 1 AS one FROM (SELECT *, sum(docs) OVER (PARTITION BY term) AS every FROM counts) WHERE every >= {LEAST}"""
_SHARE = f"(1 + {UNIT}::HUGEINT * ({{}} + {SMOOTH}) // ({{}} + {SMOOTH} * v))::BIGINT"
#: From kept (source, term, n) and sources (source, n_source, n_lang, v) of one shard. near: a source's term against another source, which has it (b) or not.
SHARES = f"""CREATE TEMP TABLE p AS SELECT source, term, {_SHARE.format('n', 'n_source')} AS p FROM kept JOIN sources USING (source)"""
PAIRS = f"""WITH s AS (SELECT source, CASE WHEN v > 0 THEN {_SHARE.format('0', 'n_source')} ELSE 0 END AS zero FROM sources), has AS (SELECT source, count(*) AS k FROM p GROUP BY source),
near AS (SELECT p.source AS a, s.source AS b, sum(abs(p.p - coalesce(o.p, s.zero))) AS far, coalesce(sum(abs(p.p - s.zero)) FILTER (o.p IS NULL), 0) AS alone, count(*) FILTER (o.p IS NULL) AS k
FROM p JOIN s ON p.source <> s.source LEFT JOIN p o ON o.term = p.term AND o.source = s.source GROUP BY ALL)
SELECT a.source, b.source AS item, (coalesce(x.far, 0) + coalesce(y.alone, 0) + abs(a.zero - b.zero) * ((SELECT count(DISTINCT term) FROM p) - coalesce(has.k, 0) - coalesce(y.k, 0)))::BIGINT AS value
FROM s a JOIN s b ON a.source <> b.source LEFT JOIN has ON has.source = a.source LEFT JOIN near x ON x.a = a.source AND x.b = b.source LEFT JOIN near y ON y.a = b.source AND y.b = a.source"""
LEADING = f"""SELECT source, term AS item, value FROM (SELECT p.source, p.term, p.p - {_SHARE.format('l.n', 'n_lang')} AS value FROM p JOIN (SELECT term, sum(n) AS n FROM kept GROUP BY term) l USING (term) JOIN sources USING (source))
WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= {TOP}"""


def _connection():
    import duckdb

    # nothing is written to local disk
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def _told(con, query: str) -> pa.Table:
    return con.sql(query).to_arrow_table()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of every term."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    names = ["lang", "source", "term", "n", "docs"]
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        con = _connection()
        for batch in batches:
            for row, stop, *_ in tx.slices(batch.column(2)):
                part = pa.Table.from_batches([batch.slice(row, stop - row)])
                con.register("texts", part.append_column("row", pa.array(range(len(part)), pa.int64())))
                found = _told(con, COUNTED).select(names).cast(schema)
                con.unregister("texts")
                yield from found.to_batches(1 << 16)

    parts = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _kept(key, table):
    con = _connection()
    con.register("counts", table)
    return _told(con, KEPT).select(["lang", "shard", "source", "term", "n", "one"]).cast(pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("one", pa.bool_())]))


def _compared(key, kept, sources):
    con = _connection()
    con.register("kept", kept)
    con.register("sources", sources)
    con.execute(SHARES)
    out = []
    for part, query in (("pair", PAIRS), ("term", LEADING)):
        found = _told(con, query)
        n = len(found)
        out.append(pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "source": found["source"].cast(pa.string()), "part": pa.array([part] * n, pa.string()), "item": found["item"].cast(pa.string()), "value": found["value"].cast(pa.int64())}))
    return pa.concat_tables(out)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: of part pair the other sources by how far they are, of part term the terms that the source has more than its language."""
    with Scratch(docs.sparkSession) as own:
        counted = own.settle(counts(docs, text, lang, source), "counts")
        groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
        shards = own.settle(counted.groupBy("lang").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards")), "shards")
        dealt = counted.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
        kept = own.settle(dealt.drop("shards").groupBy("lang", "shard").applyInArrow(_kept, "lang string, shard long, source string, term string, n long, one boolean"), "kept")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count_if("one").alias("ones"))
        sums = own.settle(groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n_source", "ones"]), "sources")
        langs = sums.groupBy("lang").agg(F.sum("n_source").alias("n_lang"), F.sum("ones").alias("v"))
        known = sums.drop("ones").join(langs, "lang").join(shards, "lang", "left")
        # a language has a shard for every SHARD rows of counts, so that its sources come to all shards in fewer rows than those
        known = known.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shards", F.lit(1).cast("long")) - 1))).drop("shards")
        keys = ["lang", "shard"]
        compared = kept.groupBy(keys).cogroup(known.groupBy(keys)).applyInArrow(_compared, "lang string, source string, part string, item string, value long")
        total = own.settle(compared.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "totals")
        own.keep(total)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(order)).filter(f"part = 'pair' OR rank <= {TOP}")


def oracle() -> str:
    """The same by a whole grid of sources and kept terms."""
    share = f"(1 + {UNIT}::HUGEINT * (n + {SMOOTH}) // (sum(n) OVER w + {SMOOTH} * count(*) OVER w))::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest({_WORDS}) AS term FROM d), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST}), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, {share} AS p FROM x WINDOW w AS (PARTITION BY lang, source)), q AS (SELECT lang, term, {share} AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT p.lang, source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
