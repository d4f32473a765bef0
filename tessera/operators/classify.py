"""Ordered rules that classify pages and texts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U

# --- fixed values ----------------------------------------------------------------------------

BLOCK_MARKERS = ("access denied", "attention required", "cloudflare", "captcha", "datadome", "perimeterx", "security check", "please verify you are a human", "checking your browser", "reference #")
ERROR_MARKERS = ("internal server error", "service unavailable", "bad gateway", "page not found", "404 not found")
LOGIN_MARKERS = ("sign in", "log in", "login", "forgotten your password", "keep me signed in", "create an account")
SCRIPT_MARKERS = ("please enable javascript", "enable javascript to proceed", "requires javascript to function", "you need to enable javascript")
LISTING_WORDS = ("searchtype=", "query=", "page=", "offset=")
BOILERPLATE_TERMS = ("cookie policy", "terms of use", "privacy policy", "all rights reserved", "accept all cookies", "согласие на обработку")
CHALLENGE_MARKERS = ("please enable javascript", "checking your browser", "cloudflare", "ddos-guard", "access denied", "captcha", "verify you are human", "security check")
BLOCK_PATTERNS = ("cloudflare", "attention required", "access denied", "captcha", "datadome", "perimeterx", "security check", "please verify you are a human", "bot detection", "checking your browser before accessing")
SHELL_PATTERN = r"<div\s+id=[\"'](root|app|__next)[\"']\s*>\s*</div>|you need to enable javascript to run this app|please enable javascript"
FRAMEWORKS = {
    "Next.js": ("__next_data__", "next/static", "__next"),
    "Nuxt": ("__nuxt__", "nuxt.js"),
    "React": ("data-reactroot", 'id="react-root"', "react-dom", "/react."),
    "Vue": ("v-app", "data-v-", "vue.js", "vue.runtime"),
    "Angular": ("ng-version", "ng-app", "ng-controller"),
}
PAGE_BLOCK_MARKERS = ("captcha", "cloudflare", "access denied", "checking your browser", "just a moment...")
EVIDENCE_MARKERS = ("doi:", "pmid", "reference", "references", "источник", "литература", "таблица", "табл.", "рис.", "figure", "table", "исследование", "результаты", "вывод", "method", "experiment", "conclusion", "p-value", "p <")


def found(text: Column, markers: tuple[str, ...]) -> Column:
    """The markers that a text contains, in their order."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    return U.contains_any(text, markers)


def document_type(df: DataFrame) -> DataFrame:
    """Adds doc_type, accepted, reason, signals, useful_chars to rows with url, text, status_code,
    content_type, title, link_density. Null texts are empty, a null status is 200, a null density 0."""
    # What several rules read is computed once, as columns: branches of a ladder share no expressions.
    df = df.withColumns({"_low": F.lower(F.coalesce("text", F.lit(""))), "useful_chars": F.length(T.useful_text(F.col("text")))})
    df = df.withColumns({f"_{i}": found(F.col("_low"), m) for i, m in enumerate((BLOCK_MARKERS, ERROR_MARKERS, LOGIN_MARKERS, SCRIPT_MARKERS))})
    low, size = F.col("_low"), F.col("useful_chars")
    blocks, errors, logins, scripts = (F.col(f"_{i}") for i in range(4))
    status = F.coalesce("status_code", F.lit(200))
    density = F.coalesce("link_density", F.lit(0.0))
    way, words = F.lower(U.path(F.coalesce("url", F.lit("")))), F.lower(U.query(F.coalesce("url", F.lit(""))))
    code = F.when(status >= 400, F.array(F.concat(F.lit("status:"), status.cast("string")))).otherwise(F.array().cast("array<string>"))
    refused = status.isin(401, 403, 429)
    login = F.size(logins)
    form = F.contains(low, F.lit("password")) & (F.contains(low, F.lit("email")) | F.contains(low, F.lit("username")))
    listed, asked = _any(way, U.LISTING_PATHS), _any(words, LISTING_WORDS)
    names = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    mime = F.lower(F.coalesce("content_type", F.lit("")))
    odd = F.when(~F.contains(mime, F.lit("html")) & ~F.contains(mime, F.lit("text")), F.array(F.concat(F.lit("content_type:"), F.coalesce("content_type", F.lit(""))))).otherwise(F.array().cast("array<string>"))
    rules = [
        (status >= 500, "ERROR_PAGE", "HTTP_SERVER_ERROR", code),
        (refused | (F.size(blocks) > 0), "BLOCK_PAGE", "BLOCK_OR_ACCESS_DENIED", F.concat(F.when(refused, code).otherwise(F.array().cast("array<string>")), blocks)),
        ((status >= 400) | (F.size(errors) > 0), "ERROR_PAGE", "HTTP_OR_ERROR_PAGE", F.concat(code, errors)),
        (_any(way, U.AUTH_PATHS) | ((login >= 3) & ((size < 1200) | form)), "LOGIN", "AUTHENTICATION_PAGE", logins),
        (
            (F.size(scripts) > 0) | ((size < 300) & low.rlike(r"<(?:div|main)[^>]+(?:id|class)=[\"'](?:root|app|__next)")),
            "JS_SHELL", "UNRENDERED_JAVASCRIPT_SHELL", F.concat(scripts, names(("thin_spa_shell", size < 300))),
        ),
        (listed | asked | (density >= 0.65), "SEARCH_LISTING", "SEARCH_OR_DIRECTORY_PAGE", names(("listing_path", listed), ("listing_query", asked), ("high_link_density", density >= 0.65))),
        (way.isin("", "/") & (F.trim(F.coalesce("title", F.lit(""))) == "") & (size < 1200), "NAVIGATION", "DOMAIN_HOME_PAGE", F.array(F.lit("root_path"), F.lit("missing_title"))),
        (size < 120, "NAVIGATION", "INSUFFICIENT_USEFUL_TEXT", F.concat(odd, F.array(F.lit("text_too_short")))),
    ]

    def ladder(pick: int, last: Column) -> Column:
        c = F.when(rules[0][0], rules[0][pick])
        for r in rules[1:]:
            c = c.when(r[0], r[pick])
        return c.otherwise(last)

    return df.withColumns({"doc_type": ladder(1, F.lit("DOCUMENT")), "reason": ladder(2, F.lit("DOCUMENT_EVIDENCE_CANDIDATE")), "signals": ladder(3, odd)}).withColumn("accepted", F.col("doc_type") == "DOCUMENT").drop("_low", "_0", "_1", "_2", "_3")


def inspect_content(df: DataFrame) -> DataFrame:
    """Adds is_valid, main_text_ratio, link_density, is_spam, is_navigation_only, rejection_reason to rows with text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda s: s != "")
    links = F.aggregate(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\([^\)]+\)"), F.lit(1)), F.lit(0), lambda a, s: a + T.word_count(s))
    rows = df.withColumn("_rows", lines)
    total = F.aggregate("_rows", F.lit(0), lambda a, s: a + T.word_count(s))
    short = F.length(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) < 80
    flood = (F.length(text) < 500) & (F.size(found(F.lower(text), BOILERPLATE_TERMS)) >= 3)
    rows = rows.withColumns({"_n": total, "_l": links, "_lines": F.size("_rows"), "_unique": F.size(F.array_distinct("_rows")), "_thin": short, "_flood": flood}).drop("_rows")
    thin, flooded = F.col("_thin"), F.col("_flood")
    density = F.col("_l") / F.greatest("_n", F.lit(1))
    article = (F.col("_n") - F.col("_l") >= 350) & (F.col("_n") / F.greatest("_lines", F.lit(1)) >= 8)
    navigation = (density > 0.65) & ~article
    spam = (F.col("_unique") / F.greatest("_lines", F.lit(1)) < 0.35) & (F.col("_lines") > 10)
    reason = F.when(thin, "THIN_CONTENT_TOO_SHORT").when(navigation, "NAVIGATION_DIRECTORY_PAGE").when(flooded, "BOILERPLATE_DOMINATED").when(spam, "REPETITIVE_SPAM_TEMPLATE").otherwise("")
    return rows.withColumns(
        {
            "is_valid": ~(thin | navigation | flooded | spam),
            "main_text_ratio": F.when(thin, 0.0).otherwise(1 - density),
            "link_density": F.when(thin, 0.0).otherwise(F.round(density, 3)),
            "is_spam": ~thin & spam,
            "is_navigation_only": ~thin & navigation,
            "rejection_reason": reason,
        }
    ).drop("_n", "_l", "_lines", "_unique", "_thin", "_flood")


def content_quality(df: DataFrame) -> DataFrame:
    """Adds decision, overall_score, text_density, is_challenge_or_shell to rows with text and raw_chars (null: as long as the text)."""
    text = F.coalesce("text", F.lit(""))
    n = T.word_count(text)
    raw = F.greatest(F.coalesce("raw_chars", F.length(text)), F.lit(1))
    density = F.least(F.lit(1.0), F.length(text) / raw)
    empty, challenge = F.regexp_replace(text, r"[\s\p{Z}]+", "") == "", _any(F.lower(text), CHALLENGE_MARKERS)
    score = F.round(F.least(F.lit(1.0), 0.4 + 0.6 * F.least(F.lit(1.0), n / 300.0)), 3)
    return df.withColumns(
        {
            "decision": F.when(empty | challenge | ((n < 30) & (raw > 1500)), "ESCALATE").when(n < 10, "DISCARD").otherwise("ACCEPT"),
            "overall_score": F.when(empty, 0.0).when(challenge, 0.1).when((n < 30) & (raw > 1500), 0.25).when(n < 10, 0.1).otherwise(score),
            "text_density": F.when(empty, 0.0).when(challenge, 0.1).otherwise(F.round(density, 3)),
            "is_challenge_or_shell": empty | challenge,
        }
    )


def acquisition_quality(df: DataFrame, least_chars: int = 100) -> DataFrame:
    """Adds score, completeness, blocked, likely_unrendered, suggested_escalation to rows with status_code and text."""
    text = F.coalesce("text", F.lit(""))
    head = F.lower(F.substring(text, 1, 10_000))  # a block notice is looked for at the head of the page only
    status = F.coalesce("status_code", F.lit(200))
    failed, refused = status >= 400, status.isin(403, 429)
    notice, shell = _any(head, BLOCK_PATTERNS), head.rlike(SHELL_PATTERN)
    size = F.length(T.useful_text(F.col("text")))
    thin = size < least_chars
    num = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = 1.0 - num(failed, 0.6) - num(notice, 0.5) - num(shell, 0.4) - num(thin, 0.3)
    whole = F.when(failed, 0.0).otherwise(1.0)
    whole = F.when(shell, F.least(whole, F.lit(0.3))).otherwise(whole)
    whole = F.when(thin, F.least(whole, F.greatest(F.lit(0.1), size / least_chars))).otherwise(whole)
    return df.withColumns(
        {
            "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3),
            "completeness": F.round(whole, 3),
            "blocked": refused | notice,
            "likely_unrendered": shell,
            "suggested_escalation": F.when(refused | notice, "chromium").when(shell | thin, "servo"),
        }
    )


def page_intelligence(df: DataFrame) -> DataFrame:
    """Adds scores and findings to rows with status_code, content_type, html, requests (array of mime, url)."""
    mime, low = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.coalesce("html", F.lit("")))
    frameworks = F.filter(F.array(*[F.when(_any(low, m), F.lit(n)) for n, m in FRAMEWORKS.items()]), lambda x: x.isNotNull())
    requests = F.coalesce("requests", F.array().cast("array<struct<mime:string,url:string>>"))
    apis = F.transform(F.filter(requests, lambda r: F.contains(F.lower(F.coalesce(r["mime"], F.lit(""))), F.lit("json")) | F.contains(F.coalesce(r["url"], F.lit("")), F.lit("/api/")) | F.contains(F.coalesce(r["url"], F.lit("")), F.lit("graphql"))), lambda r: r["url"])
    framed, scripts, tables = F.size(frameworks) > 0, F.regexp_count(low, F.lit("<script")), F.regexp_count(low, F.lit("<table"))
    blocked = F.coalesce("status_code", F.lit(200)).isin(403, 429) | _any(low, PAGE_BLOCK_MARKERS)
    num = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    js = F.least(F.lit(1.0), 0.1 + num(framed, 0.4) + num(scripts > 15, 0.2) + num(framed & (F.length(low) < 2000), 0.3))
    js = F.when(blocked, F.greatest(js, F.lit(0.85))).otherwise(js)
    visual = F.least(F.lit(1.0), 0.1 + num(F.contains(low, F.lit("<canvas")), 0.5) + num(tables > 2, 0.3) + num(F.contains(low, F.lit("<svg")), 0.2))
    json, pdf = F.contains(mime, F.lit("json")), F.contains(mime, F.lit("pdf"))
    plain = lambda j, p, h: F.when(json, j).when(pdf, p).otherwise(h)
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "page_type": plain(F.lit("json"), F.lit("pdf"), F.lit("html")),
            "static_score": plain(F.lit(1.0), F.lit(1.0), F.round(1.0 - js, 2)),
            "js_dependency_score": plain(F.lit(0.0), F.lit(0.0), F.round(js, 6)),
            "api_score": plain(F.lit(1.0), F.lit(0.0), F.round(F.least(F.lit(1.0), F.size(apis) * 0.3), 2)),
            "visual_score": plain(F.lit(0.0), F.lit(0.8), F.round(visual, 2)),
            "quality": plain(F.lit(1.0), F.lit(0.9), F.round(1.0 - num(blocked, 0.95), 2)),
            "block_score": plain(F.lit(0.0), F.lit(0.0), num(blocked, 0.95)),
            "frameworks": plain(none, none, frameworks),
            "apis": plain(none, none, apis),
            "tables_count": plain(F.lit(0), F.lit(0), tables),
        }
    )


def stem_found(token: Column, text: Column) -> Column:
    """The token, or for longer ones its stem without the last one or two letters, is in the text."""
    stem = F.when(F.length(token) >= 6, F.substring(token, F.lit(1), F.length(token) - 2)).otherwise(F.substring(token, F.lit(1), F.length(token) - 1))
    return F.contains(text, token) | ((F.length(token) >= 4) & (F.length(stem) >= 3) & F.contains(text, stem))


def relevance(df: DataFrame, least: float = 0.15) -> DataFrame:
    """Adds relevance, tier, accepted to rows with query, entities (array), title, text."""
    text, title = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    asked = F.filter(T.tokens(F.col("query")), lambda t: F.length(t) > 2)
    entities = F.coalesce("entities", F.array().cast("array<string>"))
    coverage = F.size(F.filter(asked, lambda t: stem_found(t, text))) / F.greatest(F.size(asked), F.lit(1))
    bonus = F.least(F.lit(0.15), 0.05 * F.size(F.filter(asked, lambda t: stem_found(t, title))))
    named = F.size(F.filter(entities, lambda e: stem_found(F.lower(e), text) | stem_found(F.lower(e), title)))
    entity = F.when(F.size(entities) > 0, named / F.greatest(F.size(entities), F.lit(1))).otherwise(1.0)
    dense = 0.5 + F.when(F.regexp_count(text, F.lit(r"\b\d+(?:\.\d+)?\b")) > 3, 0.25).otherwise(0.0) + F.when(_any(text, EVIDENCE_MARKERS), 0.25).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(0.45 * coverage + 0.35 * entity + 0.15 * dense + 0.05 * (bonus / 0.15), 4))
    score = F.when(F.length(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) < 50, 0.0).otherwise(score)
    df = df.withColumn("relevance", score)
    tier = F.when(F.col("relevance") >= 0.65, "HIGH").when(F.col("relevance") >= 0.35, "MEDIUM").when(F.col("relevance") >= least, "LOW").otherwise("OFF_TOPIC")
    return df.withColumn("tier", tier).withColumn("accepted", F.col("tier") != "OFF_TOPIC")


def extraction_score(fields: Column, required: Column, records: Column, html_chars: Column, title: Column) -> Column:
    """Share of required fields .30, records .20, size of the markup / 50 000 held to .1..1 .20, title .15, any field .15."""
    found_share = F.when(F.size(required) > 0, F.size(F.array_intersect(fields, required)) / F.greatest(F.size(required), F.lit(1))).otherwise(1.0)
    density = F.greatest(F.lit(0.1), F.least(F.lit(1.0), html_chars / 50_000))
    return 0.30 * found_share + 0.20 * (records > 0).cast("double") + 0.20 * density + 0.15 * (F.coalesce(title, F.lit("")) != "").cast("double") + 0.15 * (F.size(fields) > 0).cast("double")


def satisfies(have: Column, required: Column, levels: tuple[str, ...] = ("none", "partial", "full")) -> Column:
    """Every required capability level is met by the map of capabilities there are."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(levels) for x in (n, i)])
    level = lambda v: F.coalesce(F.try_element_at(rank, F.lower(v)), F.lit(0))
    return F.forall(F.map_entries(required), lambda e: level(F.try_element_at(have, e["key"])) >= level(e["value"]))


def recommended_strategy(js_score: Column, api_score: Column, threshold: float = 0.70) -> Column:
    """API where that scores, else a browser for pages that need scripts, else plain HTTP."""
    return F.when(api_score >= 0.7, "api").when(js_score >= threshold, "browser").otherwise("http")




def recommended_cost(strategy: Column) -> Column:
    """Estimated cost of a recommended strategy: 1 for plain HTTP, 10 for the others."""
    return F.when(strategy == "http", 1.0).otherwise(10.0)
