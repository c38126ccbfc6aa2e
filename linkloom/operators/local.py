"""Local links and contacts: syntax, existence by join with the documents' own table, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls as ux

#: What findings say.
SAYS = {
    "path escape": "invalid percent escape in path: ",
    "fragment escape": "invalid percent escape in fragment: ",
    "missing": "resolved path does not exist: ",
    "directory": "anchors cannot be checked in directory: ",
    "mailto": "mailto address must be a plausible addr-spec",
    "tel": "tel number may contain only digits, +, -, parentheses, and spaces",
}


def parts(url: Column) -> tuple[Column, Column]:
    """Path without query, and fragment (null without one)."""
    head = F.substring_index(url, "#", 1)
    fragment = F.when(F.contains(url, F.lit("#")), F.substring(url, F.length(head) + 2, F.length(url)))
    return F.substring_index(head, "?", 1), fragment


def beside(source: Column, path: Column) -> Column:
    """A link's path as findings show it: rooted, or beside its source; the source itself if empty."""
    folder = F.regexp_replace(source, "[^/]*$", "")
    return F.when(path == "", source).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))


def plain(path: Column) -> Column:
    """The path without ``.``, ``..`` and empty steps; steps above the root stay at it."""
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, s: Column) -> Column:
        up = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        back = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.array_append(done, F.lit("..")))
        return F.when(s.isin("", "."), done).when(s == "..", back).otherwise(F.array_append(done, s))

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(steps, "/"))


def places(catalogue: DataFrame) -> DataFrame:
    """(target, folder): the paths of a catalogue (path), and the folders above them."""
    files = catalogue.select(plain(F.col("path")).alias("target")).distinct()
    steps = F.split("target", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    folders = files.select(F.explode(above).alias("above")).distinct()
    folders = folders.select(F.explode(F.when(F.col("above") == "", F.array(F.lit(""), F.lit("/"))).otherwise(F.array("above"))).alias("target"))
    both = files.withColumn("folder", F.lit(False)).unionByName(folders.withColumn("folder", F.lit(True)))
    return both.groupBy("target").agg(F.min("folder").alias("folder"))


def missing(links: DataFrame, catalogue: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """links (path, url) of local kind that fail: (path, url, reason, detail).

    catalogue: (path). anchors: (path, anchor) of documents whose anchors are known, a null
    anchor for one without any; others count as having any.
    """
    p, frag = parts(F.col("url"))
    rows = links.select("path", "url").distinct().withColumns({"_p": tx.percent_decoded(p), "_f": tx.percent_decoded(frag)})
    rows = rows.withColumn("shown", beside(F.col("path"), F.col("_p.value"))).withColumn("target", plain(F.col("shown"))).withColumn("anchor", F.col("_f.value"))
    rows = rows.join(places(catalogue), "target", "left")
    found = F.lit(True)
    if anchors is not None:
        own = anchors.select(plain(F.col("path")).alias("target"), "anchor").distinct()
        known = own.select("target").distinct().withColumn("known", F.lit(True))
        held = own.filter("anchor is not null").withColumn("held", F.lit(True))
        rows = rows.join(known, "target", "left").join(held, ["target", "anchor"], "left")
        found = F.col("known").isNull() | F.col("held").isNotNull()
    say = lambda k, *more: F.concat(F.lit(SAYS[k]), *more)
    syntax = F.coalesce(say("path escape", F.col("_p.error")), say("fragment escape", F.col("_f.error")))
    asked = F.col("anchor").isNotNull()
    lost = F.when(F.col("folder").isNull(), say("missing", F.col("shown"))).when(asked & F.col("folder"), say("directory", F.col("shown"))).when(asked & ~found, F.concat(F.lit("anchor not found: #"), "anchor", F.lit(" in "), "shown"))
    out = rows.select("path", "url", F.when(syntax.isNotNull(), "syntax-invalid").when(lost.isNotNull(), "local-missing").alias("reason"), F.coalesce(syntax, lost).alias("detail"))
    return out.filter("reason is not null")


def contacts(links: DataFrame) -> DataFrame:
    """mailto: and tel: links with bad syntax."""
    kind = ux.contact_scheme(F.col("url"))
    bad = F.when((kind == "mailto") & ~ux.mailto_ok(F.col("url")), SAYS["mailto"]).when((kind == "tel") & ~ux.tel_ok(F.col("url")), SAYS["tel"])
    return links.select("path", "url").distinct().withColumn("detail", bad).filter("detail is not null").select("path", "url", F.lit("syntax-invalid").alias("reason"), "detail")
