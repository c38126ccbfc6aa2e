"""From recorded HTTP observations to graded verdicts. Columns only; the first rule that fires wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as tx
from linkloom.functions import urls as ux
from linkloom.tables import Scratch

#: Confidence of each reason, and ranks (greater: more certain).
RANK = {"dead-certain": 5, "likely-dead": 4, "outdated": 3, "auth-walled": 2, "suspect": 1}
CONFIDENCE = {"network-error": "likely-dead", "soft-404": "likely-dead", "login-wall": "auth-walled", "permanent-redirect": "outdated", "staleness-banner": "outdated", "version-drift": "outdated", "far-past": "suspect", "anomalous-response": "suspect", "local-missing": "dead-certain", "syntax-invalid": "dead-certain"}
HOPS, FAR_PAST_DAYS, SIMILAR = 10, 730, 0.9
FALLBACK = (403, 405, 501)
FENCED_HOSTS = ("github.com", "gitlab.com", "login.microsoftonline.com")


def rank(confidence: Column) -> Column:
    out = F.when(confidence == "dead-certain", 5)
    for name, value in RANK.items():
        out = out.when(confidence == name, value)
    return out


def confidence(reason: Column, status: Column) -> Column:
    out = F.when((reason == "http-status") & status.isin(401, 403), "auth-walled").when((reason == "http-status") & status.isin(404, 410, 451), "dead-certain").when(reason == "http-status", "suspect")
    for name, value in CONFIDENCE.items():
        out = out.when(reason == name, value)
    return out


def outcome(status: Column, termination: Column, error_kind: Column) -> Column:
    """Reason of one observation; null: clean."""
    return F.when(error_kind.isNotNull() | termination.isNotNull(), "network-error").when(~status.between(200, 299), "http-status")


def final_status(head: Column, get: Column) -> Column:
    """HEAD decides unless its status asks for GET."""
    return F.when(head.isin(*FALLBACK), get).otherwise(head)


def network_kind(kind: Column, message: Column) -> Column:
    """timeout, conn-refused, tls, dns or other, in that order."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(kind == "timeout", "timeout").when(kind == "conn-refused", "conn-refused").when(low.rlike("tls|ssl|certificate"), "tls").when(low.rlike("dns|resolve|name or service"), "dns").otherwise("other")


def auth_component(url: Column) -> Column:
    """A path segment login or signin, a host label auth, sso or login, or a query key returnurl."""
    low = F.lower(url)
    return F.coalesce(F.exists(F.split(ux.path(low), "/"), lambda s: s.isin("login", "signin")) | F.exists(F.split(ux.host(low), r"\."), lambda s: s.isin("auth", "sso", "login")) | low.rlike("[?&]returnurl(=|&|#|$)"), F.lit(False))


def login_wall(hops: Column) -> Column:
    """hops: array<struct<status,url>> of redirects."""
    return F.exists(hops, lambda h: auth_component(h["url"]))


def permanent_redirect(status: Column, hops: Column) -> Column:
    return status.between(200, 299) & (F.size(hops) > 0) & F.forall(hops, lambda h: h["status"].isin(301, 308))


def chain(start: Column, hops: Column) -> Column:
    return F.array_join(F.concat(F.array(start), F.transform(hops, lambda h: h["url"])), " -> ")


def far_past(last_modified: Column, now: Column) -> Column:
    """last_modified: a timestamp."""
    return F.coalesce(last_modified < now - F.expr(f"INTERVAL {FAR_PAST_DAYS} DAYS"), F.lit(False))


def http_date(value: Column) -> Column:
    """The timestamp of a date as HTTP headers give it, with one digit or two of the day and a zone by name or offset; null if it isn't one."""
    bare = F.trim(F.regexp_replace(value, "^\\s*[A-Za-z]{3,9},\\s*", ""))
    offset = bare.rlike("[+-][0-9]{4}$")
    return F.when(offset, F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx"))).otherwise(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


VERDICT = "struct<confidence:string,reason:struct<kind:string,detail:string>,evidence:array<struct<kind:string,detail:string>>,tier:int>"


def verdict(kind: Column | str, detail: Column | None, evidence_kind: Column | str, evidence: Column, tier: int) -> Column:
    """A verdict (VERDICT) with one piece of evidence; detail: of reasons that have one (a status, a network error's kind)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    evidence_kind = F.lit(evidence_kind) if isinstance(evidence_kind, str) else evidence_kind
    detail = F.lit(None).cast("string") if detail is None else detail.cast("string")
    sure = confidence(kind, F.when(kind == "http-status", detail.try_cast("int")))
    proof = F.array(F.struct(evidence_kind.alias("kind"), evidence.alias("detail")))
    return F.struct(sure.alias("confidence"), F.struct(kind.alias("kind"), detail.alias("detail")).alias("reason"), proof.alias("evidence"), F.lit(tier).alias("tier")).cast(VERDICT)


def observed(o: Column, tier: int = 1) -> Column:
    """The verdict of one observation (status, termination, error_kind, error_message) alone; null: clean, or nothing observed."""
    kind = network_kind(o["error_kind"], o["error_message"])
    return (
        F.when(o["error_kind"].isNotNull(), verdict("network-error", kind, "status", F.coalesce(o["error_message"], kind), tier))
        .when(o["termination"].isNotNull(), verdict("network-error", F.lit("other"), "redirect-traversal", o["termination"], tier))
        .when(~o["status"].between(200, 299), verdict("http-status", o["status"], "status", o["status"].cast("string"), tier))
    )


def heuristic(url: Column, get: Column, upgrade: Column, beside: Column, now: Column) -> Column:
    """The verdict of a clean URL by what its GET shows (noted: words and stale in place of the body); upgrade, beside: GETs of ``version_upgrade`` and ``sibling``. A GET that failed or did not end says nothing."""
    modified = http_date(get["last_modified"])
    ok = lambda o: F.coalesce(o["status"].between(200, 299) & o["error_kind"].isNull() & o["termination"].isNull(), F.lit(False))
    alike = tx.similarity(get["words"], beside["words"])
    reason = cascade(url, get["status"], get["hops"], modified, get["stale"], F.when(ok(upgrade), upgrade["status"]), F.when(ok(beside), beside["status"]), alike, now)
    proofs = {
        "login-wall": ("redirect-chain", chain(url, get["hops"])),
        "permanent-redirect": ("redirect-target", get["final_url"]),
        "far-past": ("last-modified", F.date_format(modified, "EEE, d MMM yyyy HH:mm:ss Z")),
        "staleness-banner": ("staleness-phrase", get["stale"]),
        "version-drift": ("version-upgrade", ux.version_upgrade(url)),
        "soft-404": ("sibling-similarity", F.concat(ux.sibling(url), F.lit(" ("), tx.two_digits(alike), F.lit(")"))),
    }
    out = None
    for name, (kind, detail) in proofs.items():
        said = verdict(name, None, kind, detail, 1)
        out = F.when(reason == name, said) if out is None else out.when(reason == name, said)
    return F.when(get["error_kind"].isNull() & get["termination"].isNull(), out)


def by_cookies(o: Column) -> Column:
    """The tier 2 verdict of a GET with cookies; null: clean. Too many redirects count as status 310."""
    exhausted = F.coalesce(F.size(o["hops"]) > HOPS, F.lit(False)) | o["termination"].isNotNull()
    status = F.when(exhausted, 310).otherwise(o["status"])
    way = F.array_join(F.transform(o["hops"], lambda h: h["url"]), " -> ")
    return F.when(~exhausted & login_wall(o["hops"]), verdict("login-wall", None, "cookie-redirect-chain", way, 2)).when(~status.between(200, 299), verdict("http-status", status, "cookie-status", status.cast("string"), 2))


def page_signs(body: Column) -> Column:
    """Whether a page's text shows a wall: a captcha, a challenge, or a sign-in with a password."""
    page = tx.ascii_lower(F.coalesce(body, F.lit("")))
    password = F.lit(False)
    for sign in ('type="password"', "type='password'", 'name="password"', "name='password'"):
        password = password | F.contains(page, F.lit(sign))
    return F.contains(page, F.lit("captcha")) | F.contains(page, F.lit("challenge")) | (F.contains(page, F.lit("sign in")) & password)


def by_page(o: Column) -> Column:
    """The tier 3 verdict of a page as a browser shows it (walled: page_signs); null: clean."""
    walled = auth_component(o["final_url"]) | o["walled"]
    return F.when(~o["status"].between(200, 299), verdict("http-status", o["status"], "cookie-status", o["status"].cast("string"), 3)).when(walled, verdict("login-wall", None, "browser-page", o["final_url"], 3))


PAGES, SLOTS = 25, 4


def budgeted(urls: DataFrame, limit: int = PAGES, slots: int = SLOTS) -> DataFrame:
    """urls (url) with slot: the first ``limit`` in order are dealt to the browser's slots in turn, the others have none.

    Only the least ``limit`` URLs are numbered, so that nothing is gathered that grows.
    """
    from pyspark.sql import Window

    first = urls.select("url").distinct().orderBy("url").limit(limit)
    numbered = first.select("url", ((F.row_number().over(Window.orderBy("url")) - 1) % slots).alias("slot"))
    return urls.select("url").distinct().join(F.broadcast(numbered), "url", "left")


def exhausted() -> Column:
    """What is said of URLs beyond the budget (fixed texts)."""
    return verdict("login-wall", None, "tier-3-budget-exhausted", F.lit("tier 3 is limited to 25 links per run"), 3)


def escalates(v: Column, tier: int, host: Column) -> Column:
    """Whether a tier's verdict asks for the next one."""
    status = F.when(v["reason"]["kind"] == "http-status", v["reason"]["detail"].try_cast("int"))
    if tier == 1:
        return v.isNotNull() & escalates_to_cookies(status, v["reason"]["kind"], host)
    said = F.array_join(F.transform(v["evidence"], lambda e: F.concat_ws(" ", e["kind"], e["detail"])), " ")
    return v.isNotNull() & escalates_to_browser(v["confidence"], status, said)


def cascade(start: Column, status: Column, hops: Column, last_modified: Column, stale: Column, upgrade_status: Column, sibling_status: Column, similar: Column, now: Column) -> Column:
    """Reason after a clean status; null: clean. stale: the phrase of ``text.staleness``."""
    return (
        F.when(login_wall(hops), "login-wall")
        .when(permanent_redirect(status, hops), "permanent-redirect")
        .when(~status.between(200, 299), F.lit(None).cast("string"))
        .when(far_past(last_modified, now), "far-past")
        .when(stale.isNotNull(), "staleness-banner")
        .when(F.coalesce(upgrade_status.between(200, 299) & ux.version_upgrade(start).isNotNull(), F.lit(False)), "version-drift")
        .when(F.coalesce(sibling_status.between(200, 299) & (similar >= SIMILAR), F.lit(False)), "soft-404")
    )


def retryable(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 429)


def backoff_ms(attempt: Column, base_ms: int = 1000, cap_ms: int = 30000) -> Column:
    return F.least(F.lit(cap_ms), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def retry_after_s(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, 30 at most: a number, or a date yet to come; null otherwise."""
    number = F.when(value.rlike("^[0-9]{1,9}$"), value.try_cast("long"))
    left = F.unix_timestamp(http_date(value)) - F.unix_timestamp(now)
    asked = F.coalesce(number, F.when(left >= 0, left))
    return F.when(asked > 30, F.lit(30).cast("long")).otherwise(asked)


def wait_ms(status: Column, attempt: Column, retry_after_s: Column) -> Column:
    """Backoff, or what the server asks for on 429 if that is longer, 30 s at most."""
    asked = F.least(F.lit(30000), F.greatest(F.coalesce(retry_after_s, F.lit(0)), F.lit(0)) * 1000)
    return F.when(status == 429, F.greatest(asked, backoff_ms(attempt))).otherwise(backoff_ms(attempt)).cast("long")


def closures(edges: DataFrame, limit: int = HOPS) -> DataFrame:
    """(start, hop, url, end): the redirect chain of every url of edges (url, target), ``limit`` + 1 hops at most.

    end: terminal, loop or limit, on the last row of each chain; null before it. Ways double: those of
    up to 2^k hops, joined once, give those of up to 2^(k+1), so that 11 hops take four joins of rows of fixed width. A url of several
    targets has the least; a null url or target is no redirect.
    """
    with Scratch(edges.sparkSession) as own:
        plain = edges.filter("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target"))
        ways = own.settle(plain.select(F.col("url").alias("start"), F.lit(1).alias("hop"), F.col("target").alias("url")), "redirects")
        far = 1
        while far <= limit:
            ends = ways.filter(F.col("hop") == far).select("start", F.col("url").alias("mid"))
            on = ways.filter(F.col("hop") <= limit + 1 - far).select(F.col("start").alias("mid"), (F.col("hop") + far).alias("hop"), "url")
            longer = own.settle(ways.unionByName(ends.join(on, "mid").select("start", "hop", "url")), "redirects")
            own.drop(ways)
            ways, far = longer, far * 2
        own.keep(ways)
    # a chain has at most limit + 2 places, so that it fits an array
    rows = ways.groupBy("start").agg(F.collect_list(F.struct("hop", "url")).alias("way")).withColumn("chain", F.concat(F.array("start"), F.transform(F.array_sort("way"), lambda x: x["url"])))
    back = F.transform("chain", lambda u, i: F.array_position(F.col("chain"), u) <= i)  # the place was there before
    looped = F.array_position(back, F.lit(True)).cast("int")
    rows = rows.withColumn("looped", looped).withColumn("chain", F.when(looped > 0, F.slice("chain", F.lit(1), looped)).otherwise(F.col("chain")))
    last = F.size("chain") - 1
    end = F.when(F.col("looped") > 0, "loop").when(last > limit, "limit").otherwise("terminal")
    return rows.select("start", last.alias("last"), end.alias("_end"), F.posexplode("chain").alias("hop", "url")).select("start", "hop", "url", F.when(F.col("hop") == F.col("last"), F.col("_end")).alias("end"))


def escalates_to_cookies(status: Column, reason: Column, host: Column) -> Column:
    """Tier 1 to 2: refused, a login wall, or throttled by a host known to fence."""
    return F.coalesce(status.isin(401, 403), F.lit(False)) | F.coalesce(reason == "login-wall", F.lit(False)) | F.coalesce(status.isin(429, 503) & host.isin(*FENCED_HOSTS), F.lit(False))


def bot_fence(status: Column, evidence: Column) -> Column:
    return status.isin(403, 429, 503) & F.lower(evidence).rlike("captcha|challenge|bot")


def escalates_to_browser(conf: Column, status: Column, evidence: Column) -> Column:
    """Tier 2 to 3."""
    return F.coalesce(conf == "auth-walled", F.lit(False)) | F.coalesce(bot_fence(status, evidence), F.lit(False))


def cookie_applies(host: Column, path: Column, https: Column, now: Column) -> Column:
    """Whether a cookie row (domain, host_only, path, secure, expires) fits a URL."""
    d = F.ltrim(F.lower("domain"), F.lit("."))
    domain = F.when(F.col("host_only"), host == d).otherwise((host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    p = F.col("cookie_path")
    prefix = (path == p) | (F.startswith(path, p) & (F.endswith(p, F.lit("/")) | (F.substring(path, F.length(p) + 1, F.lit(1)) == "/")))
    return domain & prefix & (~F.col("secure") | https) & (F.col("expires").isNull() | (F.col("expires") > now))
