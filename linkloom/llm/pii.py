"""Operator 5: personal data by bootstrapped contextual extraction.

Four kinds have fixed base patterns. Their matches are seeds: the two words before a seed, however
long (the start of a text counts as a word), make a lexical pattern of its kind. Patterns and
identifier-like values (tokens with a digit or @, numbers in groups behind a bracket)
form a graph whose scores Spark works out in turns: a pattern is as good as the mean score of
its values, a value as good as its patterns together (1 for seeds). Patterns that enough
different values support and whose confidence is high then mark the values that stand behind
them and no base pattern matches. DataFrame functions only; groups are sums, so a pattern or a
value of any frequency is added up in parts.

Positions are code points. ``regexp_extract_all`` gives matches and ``split`` the text between
them; their lengths add up to positions. The expressions accept what the plain patterns in
``SAYS`` accept, but are written without backtracking, so that long runs take linear time.

Defined results: a null or empty text has no spans; repeated rows are alike; of two kinds that a
value has in one context the greater name wins; an empty table gives no rows; other columns are not
read by ``spans``, whatever their names, and returned unchanged by ``redacted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._run import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as specified.
SAYS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches. A match starts where its run of characters does, or where the last match ended (\G).
RUNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without such a place has no match.
HINTS = {"email": r"@[A-Za-z0-9]|@-", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Identifier-like values: numbers in groups behind a group in brackets, or, from the start of a run of these characters, a run with a digit or @ in it.
TOKEN = r"\([0-9]{1,5}\)[\x20-]?[0-9]++(?:[\x20-][0-9]++)*+|(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9@._%+/-]++"
SPAN = "struct<start:bigint,end:bigint,value:string,before:string>"
MENTION = "struct<start:bigint,end:bigint,kind:string,value:string,context:string>"
#: The last two words, or the one there is.
LAST = r"(?<!\S)(?:\S++\s++)?+\S++\s*+$"
#: What stands for the start of a text, as if it were a word.
START = "^ "
BLOCK = 128


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, zero: Column, kind: str, step) -> Column:
    """Running results: array of r1 = step(zero, x1), r2 = step(r1, x2) ...

    kind: the results' type. A block of results grows by one at a time and whole blocks are put
    together, so that n results cost n * (BLOCK + n / BLOCK) moves at most.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    # results so far without the last one, and the last one: so that each step is worked out once
    inner = lambda block, last: F.aggregate(block, F.struct(none.alias("out"), last.cast(kind).alias("last")), lambda a, x: F.struct(F.concat(a["out"], F.array(a["last"])).alias("out"), step(a["last"], x).cast(kind).alias("last")))
    begin = F.struct(nones.alias("done"), F.struct(none.alias("out"), zero.cast(kind).alias("last")).alias("now"))
    end = lambda a: F.flatten(F.concat(a["done"], F.array(a["now"]["out"], F.array(a["now"]["last"]))))

    def all_of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
        every = F.aggregate(blocks, begin, lambda a, block: F.struct(F.concat(a["done"], F.array(a["now"]["out"])).alias("done"), inner(block, a["now"]["last"]).alias("now")), end)
        return F.when(F.size(x) > 0, F.slice(every, F.lit(2), F.size(x))).otherwise(none)

    return let(items, all_of)


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    """The spans of all matches, with the words before each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))

    def step(last: Column, x: Column) -> Column:
        start = last["end"] + F.length(x["gap"])
        before = F.regexp_extract(F.concat(last["before"], last["value"], x["gap"]), LAST, 0)
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), before.alias("before"))

    zero = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("value"), F.lit(START).alias("before"))
    return F.when(text.rlike(hint or pattern), scan(pairs, zero, SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(value: Column) -> Column:
    """Whether a string of digits passes; from the right, every second digit doubles."""
    back = F.reverse(value)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    add = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), lambda acc, i: acc + add(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind that pass its test."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    size = lambda x, low, high: F.length(digits(x)).between(low, high)
    tests = {
        "email": None,
        "ip": lambda x: F.forall(F.split(x["value"], r"\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)),
        "card": lambda x: F.when(size(x, 16, 19), _luhn(digits(x))).otherwise(False),
        "phone": lambda x: size(x, 8, 15),
    }
    out = {}
    for kind in KINDS:
        spans = _matches(text, RUNS[kind], HINTS[kind])
        out[kind] = F.filter(spans, tests[kind]) if tests[kind] else spans
    return out


def _context(before: Column) -> Column:
    """The words before a value, letters in lower case and digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"\s+", " "))


def _apart(tokens: Column, seeds: Column) -> Column:
    """The tokens (MENTION, without kind) that overlap no seed: by one way forth, and one back, over all in order of place."""
    reach = "struct<at:bigint,x:" + MENTION + ">"
    zero = lambda at: F.struct(F.lit(at).cast("bigint").alias("at"), F.lit(None).cast(MENTION).alias("x"))
    seed = lambda x: x["kind"].isNotNull()
    clear = lambda keep: lambda p: seed(p["x"]) | keep(p)
    # a token goes if a seed before it reaches over its start, or one behind it starts before its end
    forth = scan(F.array_sort(F.concat(tokens, seeds)), zero(-1), reach, lambda last, x: F.struct(F.when(F.coalesce(seed(last["x"]), F.lit(False)), F.greatest(last["at"], last["x"]["end"])).otherwise(last["at"]).alias("at"), x.alias("x")))
    left = F.transform(F.filter(forth, clear(lambda p: p["at"] <= p["x"]["start"])), lambda p: p["x"])
    back = scan(F.reverse(left), zero(1 << 60), reach, lambda last, x: F.struct(F.when(F.coalesce(seed(last["x"]), F.lit(False)), F.least(last["at"], last["x"]["start"])).otherwise(last["at"]).alias("at"), x.alias("x")))
    return F.transform(F.filter(back, lambda p: ~seed(p["x"]) & (p["at"] >= p["x"]["end"])), lambda p: p["x"])


def _rows(own: Scratch, docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Every row with its number, base spans (one column a kind) and mentions, written to the shared folder."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), t.alias("_t")).withColumns({f"_{k}": v for k, v in base_spans(F.col("_t")).items()})
    mention = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), x["value"].alias("value"), _context(x["before"]).alias("context")).cast(MENTION)
    base = base.withColumn("_seeds", F.concat(*(F.transform(f"_{k}", mention(F.lit(k))) for k in KINDS)))
    loose = F.transform(F.filter(_matches(F.col("_t"), TOKEN, "[0-9@]"), lambda x: F.length(x["value"]) >= 5), mention(F.lit(None).cast("string")))
    base = base.withColumn("_loose", loose)
    both = (F.size("_seeds") > 0) & (F.size("_loose") > 0)
    base = base.withColumn("_mentions", F.concat("_seeds", F.when(both, _apart(F.col("_loose"), F.col("_seeds"))).otherwise(F.col("_loose"))))
    spans = {f"_{k}": F.transform(f"_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS}
    return own.settle(base.drop("_t", "_seeds", "_loose").withColumns(spans), "mentions")


def patterns(own: Scratch, mentions: DataFrame, turns: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Accepted (context, kind) of mentions (kind, value, context)."""
    edges = own.settle(mentions.groupBy("context", "value").agg(F.max("kind").alias("kind")), "edges")
    totals = edges.groupBy("context").agg(F.count("*").alias("total"))
    # (value, kind, score): seeds at first
    values = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    scored = None
    for turn in range(turns):
        found = edges.select("context", "value").join(values, "value").groupBy("context", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("n"))
        scored = own.settle(found.filter(F.col("n") >= support).join(totals, "context").withColumn("confidence", F.col("sum") / (F.col("total") + 0.5)).filter(F.col("confidence") >= confidence / 2).select("context", "kind", "confidence", "n"), "patterns")
        if turn + 1 < turns:
            miss = F.exp(F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.99)))))
            reached = edges.join(scored, "context").select("value", scored["kind"], "confidence").groupBy("value", "kind").agg((1.0 - miss).alias("score"))
            pinned = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score"))
            values = own.settle(pinned.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")), "values")
    return scored.filter(F.col("confidence") >= confidence).groupBy("context").agg(F.max(F.struct("confidence", "n", "kind"))["kind"].alias("kind"))


def _found(docs: DataFrame, keep: list[str], text: str, **options) -> DataFrame:
    """The rows of docs with ``_more``: the spans that patterns add."""
    with Scratch(docs.sparkSession) as own:
        rows = _rows(own, docs, keep, text)
        each = rows.select("_row", F.explode("_mentions").alias("m")).select("_row", "m.*")
        good = patterns(own, each.select("kind", "value", "context"), **options)
        more = each.filter("kind is null").drop("kind").join(good, "context").groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
        return own.keep(rows).drop("_mentions").join(own.keep(own.settle(more, "added")), "_row", "left")


def _all(more: Column) -> Column:
    """All spans (order, start, end, kind) of a row, by kind as listed, then start."""
    order = lambda k: sum((F.when(k == name, i).otherwise(0) for i, name in enumerate(KINDS)), F.lit(0))
    span = lambda kind: lambda x: F.struct(order(kind(x)).alias("order"), x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind"))
    fixed = lambda k: lambda x: F.lit(k)
    own = [F.transform(f"_{k}", span(fixed(k))) for k in KINDS]
    added = F.transform(more, span(lambda x: x["kind"]))
    empty = F.array().cast("array<struct<order:int,start:bigint,end:bigint,kind:string>>")
    return F.array_sort(F.concat(*own, F.coalesce(added, empty)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, counts of base spans, base_sha256, spans of every row."""
    rows = _found(docs.select(key, text), [key], text, **options)
    base = F.encode(_joined(_all(F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>"))), "utf-8")
    return rows.select(key, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), _joined(_all(F.col("_more"))).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets, like ``[EMAIL]``."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    t = f"c{names.index(text)}"
    rows = _found(plain, plain.columns, t, **options).withColumn("_spans", F.array_sort(F.transform(_all(F.col("_more")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind")))))

    kind = "struct<at:bigint,part:string>"

    def step(last: Column, x: Column) -> Column:
        part = F.substring(F.col(t), (last["at"] + 1).cast("int"), F.greatest(x["start"] - last["at"], F.lit(0)).cast("int"))
        mark = F.when(x["end"] > last["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(last["at"], x["end"]).alias("at"), F.concat(part, mark).alias("part"))

    parts = scan(F.col("_spans"), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("part")), kind, step)
    rows = rows.withColumn("_parts", parts)
    new = F.concat(F.array_join(F.transform("_parts", lambda x: x["part"]), ""), F.substring(F.col(t), (F.element_at("_parts", -1)["at"] + 1).cast("int"), F.length(t)))
    return rows.withColumn(t, F.when(F.size("_spans") > 0, new).otherwise(F.col(t))).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
