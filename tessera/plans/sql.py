"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

QUERIES = ("magnetic fields and reaction rates", "loan defaults interest rates", "appeal courts contract clauses", "symptom scores in clinical trials", "database indexes cache misses")
ENTITIES = ("quantum dots", "credit lines", "jury trials", "blood samples", "thread pools")


def tokens(text: str) -> str:
    return f"coalesce(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), [])"


def words(text: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '[^\\s\\x0B\\p{{Z}}]+'), [])"


def word_count(text: str) -> str:
    return f"len({words(text)})"


def token_estimate(text: str) -> str:
    return f"case when coalesce({text}, '') = '' then 0 else greatest(cast(floor({word_count(text)} * 1.3::double) as bigint), cast(floor(length({text}) / 3.5::double) as bigint), 1) end"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"


def trimmed_ascii(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"


def useful(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g'), '^ +| +$', '', 'g')"


def sanitised(text: str) -> str:
    return trimmed(f"regexp_replace(coalesce({text}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')")


def any_of(text: str, markers: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{m.replace(chr(39), chr(39) * 2)}')" for m in markers) + ")"


def simhash(table: str, key: str, grams: str, source: str | None = None) -> str:
    """id, u (unsigned), fingerprint of each row of ``source`` by the list expression ``grams``."""
    return f"""select id, u, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616::hugeint)::bigint else u::bigint end as fingerprint from (
      select id, sum(case when v >= 0 then (1::hugeint << i) else 0 end)::ubigint as u from (
        select id, i, sum(case when ((h >> i) & 1) = 1 then n else -n end) as v from (
          select id, n, ('0x' || substr(md5(gram), 1, 16))::ubigint as h from (select id, gram, count(*) as n from (select {key} as id, unnest({grams}) as gram from {source or table}) group by id, gram)) cross join (select unnest(range(64))::int as i)
        group by id, i) group by id)"""


def host(url: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_extract({url}, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '')"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def authority(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"


def path(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def canonical_rows(source: str) -> str:
    """The rows of ``source`` with canonical, the address ``url`` in its one form (for addresses without escapes)."""
    from tessera.functions import urls as U

    return f"""select * exclude (scheme0, net0, parts, params, scheme, net, w, way, q), scheme || '://' || net || way || case when q <> '' then '?' || q else '' end as canonical from (
  select *, case when w = '' then '/' else w end as way, array_to_string(list_sort(list_transform(list_filter(params, lambda p: not list_contains([{quoted(U.TRACKING_PARAMETERS)}], lower(string_split(p, '=')[1]))), lambda p: case when contains(p, '=') then p else p || '=' end)), '&') as q from (
   select *, array_to_string(list_filter(list_transform(range(1, len(parts) + 1), lambda i: case when parts[i] = '' and i > 1 and i < len(parts) then chr(1) else parts[i] end), lambda x: x <> chr(1)), '/') as w from (
    select *, case when scheme = 'http' then regexp_replace(net0, ':80$', '') when scheme = 'https' then regexp_replace(net0, ':443$', '') else net0 end as net from (
     select *, case when scheme0 = 'http' and net0 in ({quoted(U.HTTPS_HOSTS)}) then 'https' else scheme0 end as scheme from (
      select *, {scheme("trim(url)")} as scheme0, {authority("trim(url)")} as net0, string_split(replace({path("trim(url)")}, '%2f', '%2F'), '/') as parts, list_filter(string_split({query("trim(url)")}, '&'), lambda p: p <> '') as params from ({source}))))))"""


def half_up(x: str, places: int) -> str:
    """A double rounded half up by its shortest decimal form, as the engine rounds."""
    return f"round(cast(cast({x} as varchar) as decimal(38, 20)), {places})::double"
