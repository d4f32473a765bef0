"""Queries over captured pages and their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import classify, dedup, markup, media
from tessera.plans import sql as S
from tessera.sources import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captured_artifacts")


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("artifact_id", "url", U.canonical_url(F.col("url")).alias("canonical"), U.authority(F.col("url")).alias("domain"), U.host(F.col("url")).alias("host"))


def url_policy(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, d).select("artifact_id", U.rejection_reason(url).alias("reason"), U.is_binary_document(url).alias("binary"), U.matches_domain(url, "bocor.example").alias("own"))


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("artifact_id", "url", "captured_at").distinct()
    return dedup.distinct_urls(rows, ["captured_at", "artifact_id"]).select("canonical", "artifact_id")


def blocked_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Range test over addresses built from the ids."""
    n = F.col("artifact_id")
    address = F.concat_ws(".", F.pmod(n * 7, F.lit(256)).cast("string"), F.pmod(n * 31, F.lit(256)).cast("string"), F.pmod(n, F.lit(256)).cast("string"), F.lit("9"))
    return _pages(spark, d).select("artifact_id").distinct().select("artifact_id", address.alias("address")).withColumn("number", U.ipv4_number(F.col("address"))).withColumn("blocked", U.is_blocked_ipv4(F.col("address")))


def document_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("artifact_id", "url", F.col("text_content").alias("text"), "status_code", "content_type", F.lit("").alias("title"), F.lit(0.0).alias("link_density"))
    return classify.document_type(rows).select("artifact_id", "doc_type", "accepted", "reason", F.array_join("signals", "|").alias("signals"), "useful_chars")


def acquisition_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = classify.acquisition_quality(_pages(spark, d).select("artifact_id", "status_code", F.col("text_content").alias("text")))
    return rows.select("artifact_id", "score", "completeness", "blocked", "likely_unrendered", "suggested_escalation")


def _html(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).withColumn("html", F.decode("raw_content", "ISO-8859-1"))


def page_intelligence(spark: SparkSession, d: str) -> DataFrame:
    rows = _html(spark, d).select("artifact_id", "status_code", "content_type", "html", F.col("network_logs").alias("requests"))
    return classify.page_intelligence(rows).select("artifact_id", "page_type", "static_score", "js_dependency_score", "api_score", "visual_score", "quality", "block_score", F.array_join("frameworks", "|").alias("frameworks"), F.size("apis").alias("apis"), "tables_count")


def strategy(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_intelligence")
    rows = _pages(spark, d).select("artifact_id", classify.recommended_strategy(p["js_dependency_score"], p["api_score"]).alias("strategy"))
    return rows.withColumn("cost", classify.recommended_cost(F.col("strategy")))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return markup.links(_pages(spark, d).select("artifact_id", F.col("canonical_url").alias("url"), "raw_content"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    return markup.tables(_pages(spark, d).select("artifact_id", "raw_content"))


def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return markup.markdown(_pages(spark, d).select("artifact_id", "raw_content"))


def markdown_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = markup.markdown_forms(_pages(spark, d).select("artifact_id", "raw_content"))
    return rows.select("artifact_id", F.length("raw").alias("raw"), F.length("clean").alias("clean"), F.length("fit").alias("fit"))


def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents' addresses as links, some given an ending, an abstract or an article's number."""
    n = F.col("doc_id")
    url = F.when(n % 4 == 0, F.concat("url", F.lit("/file.PDF?x=1"))).when(n % 4 == 1, F.concat(F.lit("https://arxiv.org/abs/"), n + 1000, F.lit(".5"))).when(n % 4 == 2, F.concat(F.lit("https://x.example/PMC"), n)).otherwise(F.col("url"))
    return media.document_files(table(spark, d, "documents").where("url is not null").select(n.alias("artifact_id"), url.alias("url")))


def media_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rag_chunks").select("chunk_id", "source_url", "title").distinct()
    return rows.select("chunk_id", "source_url", media.media_name(F.col("source_url"), F.col("title")).alias("file"))


def picture_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of pictures whose sizes follow from the ids."""
    n = F.col("artifact_id")
    return media.tiles(_pages(spark, d).select(n.alias("id"), (F.pmod(n * 37, F.lit(1500)) + 200).cast("int").alias("width"), (F.pmod(n * 91, F.lit(2500)) + 100).cast("int").alias("height")).distinct())


QUERIES = {f.__name__: f for f in (url_canonical, url_policy, url_dedup, blocked_addresses, document_type, acquisition_quality, page_intelligence, strategy, html_links, html_tables, html_markdown, markdown_forms, document_links, media_names, picture_tiles)}

_P = S.path("url")
_WAY = f"case when regexp_replace(lower({_P}), '/+$', '') = '' then '/' else regexp_replace(lower({_P}), '/+$', '') end"


def _under(markers) -> str:
    return "(" + " or ".join(f"way = '{m}' or starts_with(way, '{m}/')" for m in markers) + ")"


_CANONICAL = f"""
  select *, case when scheme = 'http' then regexp_replace(net0, ':80$', '') when scheme = 'https' then regexp_replace(net0, ':443$', '') else net0 end as net from (
   select *, case when scheme0 = 'http' and net0 in ({S.quoted(U.HTTPS_HOSTS)}) then 'https' else scheme0 end as scheme from (
    select artifact_id, url, captured_at, {S.scheme("trim(url)")} as scheme0, {S.authority("trim(url)")} as net0, string_split(replace({S.path("trim(url)")}, '%2f', '%2F'), '/') as parts,
      list_filter(string_split({S.query("trim(url)")}, '&'), lambda p: p <> '') as params from captured_artifacts))"""
_URL = f"""select artifact_id, url, captured_at, scheme || '://' || net || way || case when q <> '' then '?' || q else '' end as canonical from (
  select *, case when w = '' then '/' else w end as way, array_to_string(list_sort(list_transform(list_filter(params, lambda p: not list_contains([{S.quoted(U.TRACKING_PARAMETERS)}], lower(string_split(p, '=')[1]))), lambda p: case when contains(p, '=') then p else p || '=' end)), '&') as q from (
   select *, array_to_string(list_filter(list_transform(range(1, len(parts) + 1), lambda i: case when parts[i] = '' and i > 1 and i < len(parts) then chr(1) else parts[i] end), lambda s: s <> chr(1)), '/') as w from ({_CANONICAL})))"""

ORACLE = {
    "document_links": """select doc_id as artifact_id, case doc_id % 4 when 0 then url || '/file.PDF?x=1' when 1 then 'https://arxiv.org/pdf/' || (doc_id + 1000) || '.5.pdf' else 'https://europepmc.org/backend/ptpmcrender.fcgi?accid=PMC' || doc_id || '&blobtype=pdf' end as url from documents where url is not null and doc_id % 4 < 3
      union select doc_id, url from documents where doc_id % 4 = 3 and regexp_matches(lower(url), '\\.(pdf|docx|xlsx|pptx|csv|zip)([?#]|$)')""",
    # The addresses of the tables have no escapes, so decoding and encoding change nothing here; tests hold those cases.
    "url_canonical": f"select artifact_id, url, canonical, {S.authority('url')} as domain, {S.host('url')} as host from ({_URL})",
    "url_policy": f"""with u as (select artifact_id, url, {S.scheme("url")} as scheme, {_WAY} as way, lower({S.query("url")}) as q, lower({_P}) as p from captured_artifacts)
      select artifact_id, case when scheme not in ('http', 'https') then 'UNSUPPORTED_SCHEME' when {_under(U.AUTH_PATHS)} then 'AUTHENTICATION_URL'
        when {S.any_of('way', U.BINARY_MARKERS)} or {S.any_of('q', U.BINARY_MARKERS)} then 'BINARY_DOCUMENT_URL' when {_under(U.LISTING_PATHS)} then 'SEARCH_LISTING_URL'
        when list_has_any(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '=.')), lambda x: string_split(x, '=')[1]), [{S.quoted(U.LISTING_KEYS)}]) then 'SEARCH_LISTING_URL' when way = '/' then 'DOMAIN_HOME_URL' end as reason,
        {S.any_of('p', U.BINARY_MARKERS)} or {S.any_of('q', U.BINARY_MARKERS)} as binary, coalesce({S.host('url')} = 'bocor.example' or {S.host('url')} like '%.bocor.example', false) as own from u""",
    "url_dedup": f"select canonical, artifact_id from (select *, row_number() over (partition by canonical order by captured_at nulls first, artifact_id) as k from ({_URL}) where url is not null) where k = 1",
    "blocked_addresses": f"""with a as (select distinct artifact_id, artifact_id * 7 % 256 as a, artifact_id * 31 % 256 as b, artifact_id % 256 as c from captured_artifacts), n as (select artifact_id, a || '.' || b || '.' || c || '.9' as address, cast(((a * 256 + b) * 256 + c) * 256 + 9 as bigint) as number from a)
      select artifact_id, address, number, {" or ".join(f"number between {sum(int(x) << s for x, s in zip(b.split('/')[0].split('.'), (24, 16, 8, 0)))} and {sum(int(x) << s for x, s in zip(b.split('/')[0].split('.'), (24, 16, 8, 0))) + 2 ** (32 - int(b.split('/')[1])) - 1}" for b in U.BLOCKED_IPV4)} as blocked from n""",
    "document_type": f"""with t as (select artifact_id, lower(coalesce(text_content, '')) as low, coalesce(status_code, 200) as st, lower({_P}) as way, lower({S.query("url")}) as q, length({S.useful("text_content")}) as size, content_type from captured_artifacts),
      m as (select *, list_filter([{S.quoted(classify.BLOCK_MARKERS)}], lambda x: contains(low, x)) as b, list_filter([{S.quoted(classify.ERROR_MARKERS)}], lambda x: contains(low, x)) as e, list_filter([{S.quoted(classify.LOGIN_MARKERS)}], lambda x: contains(low, x)) as l, list_filter([{S.quoted(classify.SCRIPT_MARKERS)}], lambda x: contains(low, x)) as j,
        case when st >= 400 then ['status:' || st] else [] end as code, {S.any_of('way', U.LISTING_PATHS)} as listed, {S.any_of('q', classify.LISTING_WORDS)} as asked,
        case when not contains(lower(coalesce(content_type, '')), 'html') and not contains(lower(coalesce(content_type, '')), 'text') then ['content_type:' || coalesce(content_type, '')] else [] end as odd from t),
      r as (select *, case when st >= 500 then 1 when st in (401, 403, 429) or len(b) > 0 then 2 when st >= 400 or len(e) > 0 then 3
        when {S.any_of('way', U.AUTH_PATHS)} or (len(l) >= 3 and (size < 1200 or (contains(low, 'password') and (contains(low, 'email') or contains(low, 'username'))))) then 4
        when len(j) > 0 or (size < 300 and regexp_matches(low, '<(?:div|main)[^>]+(?:id|class)=["''](?:root|app|__next)')) then 5 when listed or asked then 6 when way in ('', '/') and size < 1200 then 7 when size < 120 then 8 else 9 end as k from m)
      select artifact_id, ['ERROR_PAGE', 'BLOCK_PAGE', 'ERROR_PAGE', 'LOGIN', 'JS_SHELL', 'SEARCH_LISTING', 'NAVIGATION', 'NAVIGATION', 'DOCUMENT'][k] as doc_type, k = 9 as accepted,
        ['HTTP_SERVER_ERROR', 'BLOCK_OR_ACCESS_DENIED', 'HTTP_OR_ERROR_PAGE', 'AUTHENTICATION_PAGE', 'UNRENDERED_JAVASCRIPT_SHELL', 'SEARCH_OR_DIRECTORY_PAGE', 'DOMAIN_HOME_PAGE', 'INSUFFICIENT_USEFUL_TEXT', 'DOCUMENT_EVIDENCE_CANDIDATE'][k] as reason,
        array_to_string(case k when 1 then code when 2 then list_concat(case when st in (401, 403, 429) then code else [] end, b) when 3 then list_concat(code, e) when 4 then l when 5 then list_concat(j, case when size < 300 then ['thin_spa_shell'] else [] end)
          when 6 then list_concat(case when listed then ['listing_path'] else [] end, case when asked then ['listing_query'] else [] end) when 7 then ['root_path', 'missing_title'] when 8 then list_concat(odd, ['text_too_short']) else odd end, '|') as signals, size as useful_chars from r""",
    "acquisition_quality": f"""with t as (select artifact_id, coalesce(status_code, 200) as st, lower(substr(coalesce(text_content, ''), 1, 10000)) as head, length({S.useful("text_content")}) as size from captured_artifacts),
      f as (select *, st >= 400 as failed, st in (403, 429) as refused, {S.any_of('head', classify.BLOCK_PATTERNS)} as notice, regexp_matches(head, '<div\\s+id=["''](root|app|__next)["'']\\s*>\\s*</div>|you need to enable javascript to run this app|please enable javascript') as shell, size < 100 as thin from t)
      select artifact_id, round(greatest(0, least(1, 1.0::double - case when failed then 0.6::double else 0 end - case when notice then 0.5::double else 0 end - case when shell then 0.4::double else 0 end - case when thin then 0.3::double else 0 end)), 3) as score,
        round(least(case when failed then 0.0::double else 1.0 end, case when shell then 0.3::double else 1.0 end, case when thin then greatest(0.1::double, size / 100.0::double) else 1.0 end), 3) as completeness, refused or notice as blocked, shell as likely_unrendered,
        case when refused or notice then 'chromium' when shell or thin then 'servo' end as suggested_escalation from f""",
    "strategy": "select artifact_id, case when page_intelligence.api_score >= 0.7 then 'api' when page_intelligence.js_dependency_score >= 0.70 then 'browser' else 'http' end as strategy, case when page_intelligence.api_score >= 0.7 or page_intelligence.js_dependency_score >= 0.70 then 10.0 else 1.0 end::double as cost from captured_artifacts",
}
_NUM = lambda c, x: f"case when {c} then {x}::double else 0 end"
_FRAMED = " or ".join(S.any_of("low", m) for m in classify.FRAMEWORKS.values())
ORACLE["page_intelligence"] = f"""with t as (select artifact_id, coalesce(status_code, 200) as st, lower(coalesce(content_type, '')) as mime, lower(coalesce(raw_content::varchar, '')) as low, len(list_filter(coalesce(network_logs, []), lambda r: contains(lower(coalesce(r.mime, '')), 'json') or contains(coalesce(r.url, ''), '/api/') or contains(coalesce(r.url, ''), 'graphql'))) as apis from captured_artifacts),
  f as (select *, ({_FRAMED}) as framed, (length(low) - length(replace(low, '<script', ''))) // 7 as scripts, (length(low) - length(replace(low, '<table', ''))) // 6 as tables, st in (403, 429) or {S.any_of("low", classify.PAGE_BLOCK_MARKERS)} as blocked, contains(mime, 'json') as json, contains(mime, 'pdf') as pdf from t),
  g as (select *, greatest(least(1, 0.1::double + {_NUM("framed", 0.4)} + {_NUM("scripts > 15", 0.2)} + {_NUM("framed and length(low) < 2000", 0.3)}), case when blocked then 0.85::double else 0 end) as js, least(1, 0.1::double + {_NUM("contains(low, '<canvas')", 0.5)} + {_NUM("tables > 2", 0.3)} + {_NUM("contains(low, '<svg')", 0.2)}) as vis from f)
  select artifact_id, case when json then 'json' when pdf then 'pdf' else 'html' end as page_type, case when json or pdf then 1.0 else round(1 - js, 2) end as static_score, case when json or pdf then 0.0 else round(js, 6) end as js_dependency_score, case when json then 1.0 when pdf then 0.0 else round(least(1, apis * 0.3::double), 2) end as api_score,
    case when json then 0.0 when pdf then 0.8 else round(vis, 2) end as visual_score, case when json then 1.0 when pdf then 0.9 else round(1 - {_NUM("blocked", 0.95)}, 2) end as quality, case when json or pdf then 0.0 else {_NUM("blocked", 0.95)} end as block_score,
    case when json or pdf then '' else array_to_string(list_filter([{", ".join(f"case when {S.any_of('low', m)} then '{n}' end" for n, m in classify.FRAMEWORKS.items())}], lambda x: x is not null), '|') end as frameworks, case when json or pdf then 0 else apis end as apis, case when json or pdf then 0 else tables end as tables_count from g"""

_SLUG = "regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')"
ORACLE["media_names"] = f"""select distinct chunk_id, source_url, coalesce(case when {_SLUG} <> '' then substr({_SLUG}, 1, 60) end, 'media') || '_' || substr(sha256(source_url), 1, 8) || '.' ||
  case when regexp_extract(source_url, '\\.([A-Za-z0-9]{{2,5}})(?:[?#]|$)', 1) <> '' then lower(regexp_extract(source_url, '\\.([A-Za-z0-9]{{2,5}})(?:[?#]|$)', 1)) else 'jpg' end as file from rag_chunks"""
ORACLE["picture_tiles"] = """with p as (select distinct artifact_id as id, artifact_id * 37 % 1500 + 200 as w, artifact_id * 91 % 2500 + 100 as h from captured_artifacts),
  t as (select id, w, h, unnest(range(0, greatest(0, w - 65) + 1, 448)) as x from p), u as (select *, unnest(range(0, greatest(0, h - 65) + 1, 448)) as y from t)
  select id, x, y, least(512, w - x) as tile_width, least(512, h - y) as tile_height from u"""
