"""Operator 3: quality rules as robust multivariate outliers.

Each text gives a vector of six statistics that vary among clean texts too (square roots of
shares, which have about equal spread at any level): length of words, marks, upper case, words
that came a short while before, short words, vowels. Their deviations are scaled by the number
of words, as a short text's shares are mostly chance. Per language and source,
minimum-covariance-determinant estimates are sought by concentration steps from three starts:
distances under the last location and scatter, the closest share ``core`` of the group's
vectors, location and scatter of those. After a few steps the start of the least determinant goes
on until a step lowers its logarithm by under a thousandth,
and the vectors within its 97.5 % distance give the final, re-weighted estimates. All
steps are grouped sums over one settled table, so that a group of any size is summed in parts,
and the estimates stay a table. A text is rejected if its squared Mahalanobis distance is over
``cutoff``, or by the fixed base rules.

Defined results: a null text has no words and fails the base rules; null language or source
is a group of its own; a group under ``least`` different usable vectors is judged by the
estimates of its whole language, and if that is as small, by those of all documents; with under
``least`` in all, only the base rules judge. Equal vectors count once in a group, so that
copies do not narrow it; ties of starts go to the first; an empty table gives no rows; other
columns are not read or, in ``kept_rows``, returned unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import _text as tx
from linkloom.llm._run import Scratch

#: Fixed value: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["v_length", "v_marks", "v_upper", "v_again", "v_short", "v_vowels"]
#: The words at which a deviation counts 1 / sqrt(2): far more than most texts have, so that chance is alike in texts of most lengths.
HALF = 400.0
#: Variance that chance alone gives a statistic at HALF words: 1 / 4 of the count a share is of (words; characters and letters, six a word). No
#: group's variance is taken for less, so that one number or name is no outlier among texts that have none.
CHANCE = np.array([1 / (4 * HALF), 1 / (24 * HALF), 1 / (24 * HALF), 1 / (4 * HALF), 1 / (4 * HALF), 1 / (24 * HALF)])
#: Added to every variance besides: keeps a scatter invertible where statistics depend on each other.
RIDGE = 1e-5
#: How many words back a word counts as coming again, and the letters of a short word.
BACK, SHORT = 50, 3

_SYMBOL, _MARK, _UPPER, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER[65:91] = True
_LEAD[0x80:0xC0] = False
_LETTER, _VOWEL = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_VOWEL[list(b"aeiouAEIOU")] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which (doc, key) come twice or more."""
    both = tx.pair(doc.astype(np.uint64), key)
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(both), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def counts(buf: np.ndarray, offs: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base counts of every row, and those that only vectors use."""
    n = len(offs) - 1
    solid = ~tx.SPACE[buf]
    start, end, doc = tx.words(buf, offs)
    prefix = tx.byte_prefix(buf)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": _sums(solid & _LEAD[buf], offs), "n_symbols": _sums(_SYMBOL[buf], offs), "marks": _sums(_MARK[buf], offs), "upper": _sums(_UPPER[buf], offs)}
    # lines end at \n and at row ends
    cut = np.flatnonzero(buf == 10)
    row = np.searchsorted(offs, cut, "right") - 1
    begin = np.concatenate([offs[:-1], cut + 1])
    whose = np.concatenate([np.arange(n), row])
    order = np.lexsort((begin, whose))
    begin, whose = begin[order], whose[order]
    stop = np.r_[begin[1:] - 1, 0]
    last = np.r_[whose[1:] != whose[:-1], True] if n else np.zeros(0, bool)
    stop[last] = offs[1:]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    full = total[stop] > total[begin]
    begin, stop, whose = begin[full], stop[full], whose[full]
    key = tx.pair(whose.astype(np.uint64), prefix.spans(begin, stop))
    _, one = np.unique(key, return_index=True)
    out["lines"] = np.bincount(whose, minlength=n)
    out["n_dup_lines"] = out["lines"] - np.bincount(whose[one], minlength=n)
    # for vectors: words that were there among the last ones, short words, vowels
    said = prefix.spans(start, end)
    order = np.argsort(tx.pair(doc.astype(np.uint64), said), kind="stable")
    again = np.zeros(len(start), bool)
    again[order[1:]] = (said[order[1:]] == said[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (order[1:] - order[:-1] <= BACK)
    out["again"] = np.bincount(doc[again], minlength=n)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LEAD[buf], out=chars[1:])
    out["short"] = np.bincount(doc[chars[end] - chars[start] <= SHORT], minlength=n)
    out["letters"], out["vowels"] = _sums(_LETTER[buf], offs), _sums(_VOWEL[buf], offs)
    # words in windows that come twice
    at = np.arange(max(0, len(start) - window + 1))
    at = at[doc[at] == doc[at + window - 1]] if len(at) else at
    hashes = tx.Prefix(said).spans(at, at + window)
    twice = at[_repeats(doc[at], hashes)]
    change = np.zeros(len(start) + 1, np.int64)
    change[twice] += 1
    np.subtract.at(change, twice + window, 1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=n)
    return out


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Logarithm of the mean length of words, and square roots of shares; 3/8 is added to counts, which keeps the spread even near 0."""
    words, chars, letters = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "letters"))
    share = lambda k, of: np.sqrt((c[k] + 0.375) / of)
    return np.stack([np.log(chars / words), share("marks", chars), share("upper", chars), share("again", words), share("short", words), share("vowels", letters)])


def measured(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry``, base counts and vector of every row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = ", ".join([kinds, *(f"{c} long" for c in BASE), *(f"{c} double" for c in VECTOR)])

    def run(batches):
        for batch in batches:
            for row, stop, buf, offs in tx.slices(batch.column(len(carry)), 1 << 20):
                c = counts(buf, offs)
                columns = [batch.column(i).slice(row, stop - row) for i in range(len(carry))]
                columns += [pa.array(c[k].astype(np.int64)) for k in BASE] + [pa.array(v) for v in vectors(c)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, *BASE, *VECTOR])

    return docs.select(*carry, text).mapInArrow(run, schema)


def _base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


P = len(VECTOR)
SALT = 64
#: What names a group of estimates: level 0 is a language and source, 1 a language, 2 all documents.
KEYS = ["_level", "_lang", "_source"]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


ESTIMATE = [*(f"m_{i}" for i in range(P)), *(f"w_{i}_{j}" for i, j in PAIRS), "det"]
SUMS = ["n", "a", *(f"s_{i}" for i in range(P)), *(f"q_{i}_{j}" for i, j in PAIRS)]


def _matrix(g, name: str) -> np.ndarray:
    out = np.zeros((len(g), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = g[f"{name}_{i}_{j}"].to_numpy(float)
    return out


def _stated(keys: dict, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Estimates as columns: location m_i, inverse scatter w_ij, logarithm of the determinant."""
    spread = np.einsum("kii->ki", cov)
    cov = cov + (RIDGE + np.maximum(CHANCE - spread, 0))[:, :, None] * np.eye(P)
    back = np.linalg.inv(cov) if len(cov) else cov
    out = keys | {f"m_{i}": mean[:, i] for i in range(P)} | {f"w_{i}_{j}": back[:, i, j] for i, j in PAIRS}
    return pd.DataFrame(out | {"det": np.linalg.slogdet(cov)[1] if len(cov) else np.zeros(0)})


def _solved(sums: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Grouped sums (SUMS) -> estimates."""

    def run(parts):
        for g in parts:
            g = g[g["n"] > 0]
            n, a = g["n"].to_numpy(float), g["a"].to_numpy(float)
            mean = np.stack([g[f"s_{i}"].to_numpy(float) / a for i in range(P)], 1)
            cov = (_matrix(g, "q") - a[:, None, None] * mean[:, :, None] * mean[:, None, :]) / n[:, None, None]
            yield _stated({k: g[k] for k in keys}, mean, cov * scale)

    return sums.mapInPandas(run, ", ".join([*(f"{k} {'string' if k[0] == '_' else 'double'}" for k in keys), *(f"{c} double" for c in ESTIMATE)]))


#: Square of the scale of a text's deviations.
NEAR = f"(n_words / (n_words + {HALF}D))"
#: Squared distance of a row from the estimates joined to it; one text each, as columns of many terms are slow to put together.
_PARTS = [f"{1 if i == j else 2} * w_{i}_{j} * ({VECTOR[i]} - m_{i}) * ({VECTOR[j]} - m_{j})" for i, j in PAIRS]
DISTANCE = f"({NEAR} * ({' + '.join(_PARTS)}))"


#: Counts and weighted sums of rows, as SUMS names them.
_VALUES = ["count(*) AS n", f"sum({NEAR}) AS a", *(f"sum({NEAR} * {v}) AS s_{i}" for i, v in enumerate(VECTOR)), *(f"sum({NEAR} * {VECTOR[i]} * {VECTOR[j]}) AS q_{i}_{j}" for i, j in PAIRS)]


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and weighted sums by keys; a group's salted parts are summed first."""
    parts = rows.groupBy(*keys, "_salt").agg(*map(F.expr, _VALUES))
    return parts.groupBy(keys).agg(*(F.expr(f"sum({c}) AS {c}") for c in SUMS))


def _joined(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's estimates: a group's rows meet them in SALT parts, however large it is."""
    return rows.join(estimates.selectExpr("*", f"explode(sequence(0, {SALT - 1})) AS _salt"), [*keys, "_salt"])


def _groups(own: Scratch, rows: DataFrame, least: int) -> DataFrame:
    """Per _lang and _source of rows: ``own``, the group of estimates that judges it (null: none), and ``feeds``, those that its vectors are summed in."""
    usable = rows.filter(~_base_failed()).select("_lang", "_source", "n_words", *VECTOR).distinct().groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    sizes = rows.select("_lang", "_source").distinct().join(usable, ["_lang", "_source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    level = F.when(F.col("n") >= least, "0").when(F.col("n_lang") >= least, "1").otherwise("2")
    sizes = own.settle(sizes.join(sizes.groupBy("_lang").agg(F.sum("n").alias("n_lang")), "_lang").withColumn("level", level), "sizes")
    wide = sizes.groupBy("_lang").agg(F.max(F.col("level") == "1").alias("by_lang"))
    any_, all_ = sizes.agg(F.max(F.col("level") == "2"), F.sum("n")).first()
    all_ok = (all_ or 0) >= least
    group = lambda k, *names: F.struct(F.lit(k).alias("_level"), *(x.alias(y) for x, y in zip(names, KEYS[1:])))
    one, two, three = group("0", F.col("_lang"), F.col("_source")), group("1", F.col("_lang"), F.lit("")), group("2", F.lit(""), F.lit(""))
    judge = F.when(F.col("level") == "0", one).when(F.col("level") == "1", two).when(F.lit(all_ok), three)
    feeds = F.filter(F.array(F.when(F.col("level") == "0", one), F.when(F.col("by_lang"), two), F.when(F.lit(bool(any_) and all_ok), three)), lambda x: x.isNotNull())
    return own.settle(sizes.join(wide, "_lang").select("_lang", "_source", judge.alias("own"), feeds.alias("feeds")), "groups")


def _starts(own: Scratch, usable: DataFrame) -> DataFrame:
    """Three first estimates a group: medians and absolute deviations; mean and scatter of all; medians and the scatter of directions."""
    middle = own.settle(usable.groupBy(KEYS).agg(*(F.expr(f"percentile_approx({v}, 0.5) AS m_{i}") for i, v in enumerate(VECTOR))), "medians")
    off = [f"sqrt({NEAR}) * ({v} - m_{i})" for i, v in enumerate(VECTOR)]
    mad = _joined(usable, middle, KEYS).groupBy(KEYS).agg(*(F.expr(f"percentile_approx(abs({x}), 0.5) AS e_{i}") for i, x in enumerate(off)))
    middle = own.settle(middle.join(mad, KEYS).selectExpr(*KEYS, *(f"m_{i}" for i in range(P)), *(f"e_{i} * 1.4826D + 1e-4D AS e_{i}" for i in range(P))), "medians")
    unit = _joined(usable, middle, KEYS).selectExpr(*KEYS, "_salt", *(f"{x} / e_{i} AS u_{i}" for i, x in enumerate(off)))
    size = " + ".join(f"u_{i} * u_{i}" for i in range(P))
    signs = unit.groupBy(*KEYS, "_salt").agg(F.expr("count(*) AS n"), *(F.expr(f"sum(u_{i} * u_{j} / ({size} + 1e-12D)) AS q_{i}_{j}") for i, j in PAIRS))
    signs = signs.groupBy(KEYS).agg(F.expr("sum(n) AS n"), *(F.expr(f"sum(q_{i}_{j}) AS q_{i}_{j}") for i, j in PAIRS)).join(middle, KEYS)

    def run(parts):
        for g in parts:
            mean = np.stack([g[f"m_{i}"].to_numpy(float) for i in range(P)], 1)
            e = np.stack([g[f"e_{i}"].to_numpy(float) for i in range(P)], 1)
            turned = P * _matrix(g, "q") / g["n"].to_numpy(float)[:, None, None] * e[:, :, None] * e[:, None, :]
            for name, cov in (("0", e[:, :, None] ** 2 * np.eye(P)), ("2", turned)):
                yield _stated({k: g[k] for k in KEYS} | {"_start": name}, mean, cov)

    kinds = ", ".join([*(f"{k} string" for k in [*KEYS, "_start"]), *(f"{c} double" for c in ESTIMATE)])
    plain = _solved(_summed(usable, KEYS), KEYS).withColumn("_start", F.lit("1"))
    return own.settle(signs.mapInPandas(run, kinds).unionByName(plain), "starts")


#: Distances are dealt by their logarithm into so many classes a doubling, so that a share of a group is found by counts.
CLASSES = 64


CLASS = f"CAST(floor(log2({DISTANCE} + 1e-9D) * {CLASSES}) AS int)"


def _step(own: Scratch, usable: DataFrame, now: DataFrame, core: float) -> DataFrame:
    """Estimates of the closest share ``core`` of each group's vectors, per start; was: the determinant before.

    The rows are read once: their sums by class of distance, of which a group has some hundreds, give the edge of the core and its sums.
    """
    keys = [*KEYS, "_start", "was"]
    now = now.select(*KEYS, "_start", *ESTIMATE).withColumnRenamed("det", "was")
    parts = _joined(usable, now, KEYS).groupBy(*keys, F.expr(f"{CLASS} AS class")).agg(*map(F.expr, _VALUES))
    named = ", ".join(keys)
    parts = parts.selectExpr("*", f"sum(n) OVER (PARTITION BY {named} ORDER BY class) - n AS before", f"sum(n) OVER (PARTITION BY {named}) AS every")
    inner = parts.filter(f"before < {core}D * every").groupBy(keys).agg(*(F.expr(f"sum({c}) AS {c}") for c in SUMS))
    return own.settle(_solved(inner, keys), "estimates")


def estimates(own: Scratch, rows: DataFrame, groups: DataFrame, core: float = 0.75, first: int = 3, steps: int = 30) -> DataFrame:
    """Location and inverse scatter per group of estimates (KEYS): ``first`` steps from each start, then the best start until it stands."""
    usable = rows.filter(~_base_failed()).join(groups, ["_lang", "_source"]).select(F.explode("feeds").alias("g"), "n_words", *VECTOR).select("g.*", "n_words", *VECTOR).distinct()
    usable = own.settle(usable.withColumn("_salt", F.pmod(F.xxhash64("n_words", *VECTOR), F.lit(SALT)).cast("int")), "usable")
    now = _starts(own, usable)
    for _ in range(first):  # a step lowers every determinant or leaves it
        new = _step(own, usable, now, core)
        own.drop(now)
        now = new
    order = F.struct("det", "_start")
    now = own.settle(now.groupBy(KEYS).agg(F.min("_start").alias("_start"), *(F.min_by(c, order).alias(c) for c in ESTIMATE)), "best")
    over = []
    for left in range(steps, 0, -1):  # each group goes on until a step hardly lowers its own determinant
        new = _step(own, usable, now, core)
        still = "was - det >= 1e-3D"
        now = new.filter(still)
        over.append(new.filter(f"NOT {still}") if left > 1 else new)
        if now.isEmpty():
            break
    best = over[0]
    for x in over[1:]:
        best = best.unionByName(x)
    best = own.settle(best.select(*KEYS, *ESTIMATE), "best")
    inner = _joined(usable, best, KEYS).filter(f"{DISTANCE} <= {_consistency(core) * _quantile(0.975)!r}D")
    return own.settle(_solved(_summed(inner, KEYS), KEYS, _consistency(0.975)), "estimates")


def _cdf(x: float, k: int) -> float:
    """Of chi-square with an even number k of degrees."""
    from math import exp, factorial

    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))


def _quantile(share: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cdf(mid, P) < share else (lo, mid)
    return lo


def _consistency(core: float) -> float:
    """By what the scatter of the closest share of normal rows is too small."""
    return core / _cdf(_quantile(core), P + 2)


#: The distance that normal rows exceed once in a billion: clean texts have heavier tails than normal ones.
CUTOFF = 53.3
#: Different usable vectors that a group's own estimates take.
LEAST = 50


def judged(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, base counts, base_failed, kept, d2 (null: there are too few usable texts)."""
    with Scratch(docs.sparkSession) as own:
        grouped = docs.select(F.col(key), F.col(text), F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("_source"))
        rows = own.settle(measured(grouped, [key, "_lang", "_source"], text), "vectors")
        groups = _groups(own, rows, least)
        found = estimates(own, rows, groups)
        own.keep(rows, groups, found)
    # both are small beside the rows and are sent to all executors if their size allows; if not, a large group's rows are split at run time
    judging = rows.join(groups.select("_lang", "_source", "own"), ["_lang", "_source"]).select(key, "n_words", *(b for b in BASE if b != "n_words"), *VECTOR, "own.*")
    d = judging.join(found, KEYS, "left").withColumn("d2", F.expr(DISTANCE)).withColumn("base_failed", _base_failed())
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return d.select(key, *BASE, "base_failed", kept.alias("kept"), "d2")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose text is kept, all columns unchanged; rows are told apart by key (null too) and text."""
    own = "_key_and_text"
    while own in docs.columns:
        own += "_"
    named = docs.withColumn(own, F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")))
    good = judged(named, key=own, text=text, **options).filter("kept").select(own).distinct()
    return named.join(good.hint("merge"), own, "left_semi").drop(own)  # both sides grow with the documents
