"""The queries of ``queries`` once more, as SQL over the given tables.

Written for DuckDB and on its own logic: suffixes by a join and an aggregate instead of one join per
depth, ids by a window, rounds of propagation unrolled, aliases by recursion.
"""

from __future__ import annotations

from workload.rules import PRIVATE_RULES, RULES

_RULES = ", ".join(
    f"('{rule}', {str(private).lower()})"
    for rules, private in ((RULES, False), (PRIVATE_RULES, True))
    for rule in rules
)
_DOMAIN = "^(?:[a-zA-Z0-9](?:[a-zA-Z0-9_-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z0-9][A-Za-z0-9_-]{0,61}[A-Za-z]$"


def _is_domain(name: str) -> str:
    return f"regexp_matches({name}, '{_DOMAIN}')"


def _is_v4(text: str) -> str:
    return (
        f"(len(string_split({text}, '.')) = 4 and "
        f"len(list_filter(string_split({text}, '.'), lambda g: regexp_full_match(g, '[0-9]+') "
        f"and coalesce(try_cast(g as integer), 999) < 256)) = 4)"
    )


def _is_v6(text: str) -> str:
    groups = f"string_split({text}, ':')"
    tail = f"string_split({text}, ':')[-1]"
    has_v4 = f"contains({tail}, '.')"
    hexes = f"(case when {has_v4} then list_slice({groups}, 1, len({groups}) - 1) else {groups} end)"
    blanks = f"len(list_filter({hexes}, lambda g: g = ''))"
    good = (
        f"len(list_filter({hexes}, lambda g: g = '' or (regexp_full_match(g, '[0-9a-fA-F]+') "
        f"and (len(ltrim(g, '0')) <= 4 or ltrim(g, '0') = '10000')))) = len({hexes})"
    )
    return (
        f"(contains({text}, ':') and (not {has_v4} or {_is_v4(tail)}) "
        f"and len({hexes}) <= (case when {has_v4} then 6 else 8 end) and {good} "
        f"and ({blanks} < 2 or ({blanks} = 2 and {hexes}[1] = '' and {hexes}[2] = '')))"
    )


def _is_ip(text: str) -> str:
    return f"coalesce({_is_v4(text)} or {_is_v6(text)}, false)"


def _sanitized(url: str) -> str:
    text = f"url_encode(coalesce({url}, ''))"
    for code, char in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&")):
        text = f"replace({text}, '{code}', '{char}')"
    return text


def _spread(number: str) -> str:
    return f"({number} // 256) % 256, '.', {number} % 256"


def _suffix_matches(names: str, private: bool) -> str:
    """CTE body ``name, labels, suffix``; the longest rule wins and exceptions are one label shorter."""
    return f"""
        select name, labels, max_by(length, matched) as suffix from (
            select n.name, n.labels, k.k + (case when r.rule = '*.' || k.tail then 1 else 0 end) as matched,
                case when r.rule = '!' || k.tail then k.k - 1
                     when r.rule = '*.' || k.tail then k.k + 1 else k.k end as length
            from (select name, string_split(lower(name), '.') as labels from {names}) n,
                lateral (select u.k as k, array_to_string(list_slice(n.labels, len(n.labels) - u.k + 1, len(n.labels)), '.') as tail
                         from unnest(range(1, len(n.labels) + 1)) u(k)) k
            join suffix_rules r on r.rule in (k.tail, '*.' || k.tail, '!' || k.tail)
                {"" if private else "and not r.private"}
            where r.rule <> '*.' || k.tail or len(n.labels) > k.k
        ) group by name, labels"""


_VIEWS = f"""
suffix_rules(rule, private) as (values {_RULES}),
page_hosts as (
    select page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host from pages),
page_count as (select count(*) as n from pages),
hosts as (
    select e.event_id as id,
        concat('198.', {_spread("e.user_id")}, '.', e.event_id % 16) as ip,
        p.host as server_name,
        case when e.event_type = 'error' and e.event_id % 2 = 0 then 'x: invalid signature by the server certificate'
             when e.event_type = 'error' then 'timeout' end as error_data,
        case when e.event_type <> 'signup' then sha256(concat('cert', e.user_id % c.n)) end as cert_hash,
        case when e.event_type = 'error' then 0 when e.event_type = 'view' then null else 1 end as cert_valid,
        cast(e.ts as date) as scan_date
    from events e, page_count c, page_hosts p where p.page_id = e.event_id % c.n),
http as (
    select e.event_id as id, cast(e.ts as date) as scan_date,
        case when e.event_id % 4 = 0 then '/relative' else p.url end as location
    from events e, page_count c, page_hosts p
    where p.page_id = (e.event_id * 7) % c.n),
certs as (
    select sha1(concat('cert', a.page_id)) as sha1, sha256(concat('cert', a.page_id)) as sha256,
        'CN=' || a.host as subject, 'CN=' || b.host as issuer, '2024-01-01T00:00:00Z' as notBefore,
        concat('2025-01-01T00:00:0', a.page_id % 10, 'Z') as notAfter,
        a.page_id % 3 > 0 as basicConstraints, a.page_id % 3 = 1 as isCa,
        case when a.page_id % 13 = 0 then 0 else 2 end as numAltNames,
        case when a.page_id % 11 = 0 or a.page_id % 13 = 0 then null
             when a.page_id % 5 = 0 then [a.host, concat('192.0.', {_spread("a.page_id")})]
             else [a.host, '*.' || b.host] end as names
    from page_hosts a, page_count c, page_hosts b where b.page_id = (a.page_id * 3) % c.n),
dns as (
    select concat('198.', {_spread("page_id")}, '.', page_id % 16) as ip, host as domain, 'web-A' as scan_src,
        date '2024-01-01' as scan_date from page_hosts
    union all
    select concat('2001:db8::', page_id % 10000), host, 'web-AAAA', date '2024-01-02' from page_hosts),
sans as (
    select guid, case when not is_ip then name end as domain_name, case when is_ip then name end as ip
    from (select 'c_' || sha256 as guid, name, {_is_ip("name")} as is_ip
          from (select sha256, unnest(names) as name from certs))),
target_names as (
    select distinct location, regexp_extract(regexp_replace(location, '^[A-Za-z0-9+.-]+://', ''), '^([^/?#:]*)', 1) as name
    from http),
target_suffixes as ({_suffix_matches("(select distinct name from target_names)", private=False)}),
targets as (
    select h.id, h.scan_date, h.location,
        case when len(s.labels) > s.suffix and {_is_domain("t.name")} then t.name end as target
    from http h join target_names t using (location) left join target_suffixes s using (name)),
names_seen as (
    select distinct domain_name from (
        select domain_name from sans union all select server_name from hosts union all select domain from dns
        union all select target from targets) where domain_name is not null),
valid_names as (
    select domain_name as name from names_seen
    where {_is_domain("domain_name")} or {_is_domain("replace(domain_name, '*.', '')")}),
name_suffixes as ({_suffix_matches("valid_names", private=True)}),
name_chains as (
    select n.name, string_split(n.name, '.') as labels, coalesce(s.suffix, 1) as suffix
    from valid_names n left join name_suffixes s using (name)),
hierarchy as (
    select distinct array_to_string(list_slice(labels, i, len(labels)), '.') as domain_name,
        case when i < len(labels) - suffix then array_to_string(list_slice(labels, i + 1, len(labels)), '.') end as parent
    from (select name, labels, suffix, unnest(range(1, len(labels) - suffix + 1)) as i from name_chains)),
ips as (
    select distinct ip from (select ip from hosts union all select ip from dns union all select ip from sans)
    where {_is_ip("ip")}),
cert_set as (
    select 'c_' || sha256 as guid, sha1, sha256, max(subject) as subject, max(issuer) as issuer,
        max(notBefore) as notBefore, max(notAfter) as notAfter, bool_or(basicConstraints) as basicConstraints,
        bool_or(isCa) as isCa, max(numAltNames) as numAltNames
    from certs where length(sha256) = 64 group by sha1, sha256),
returns_raw as (
    select 'ip_' || ip as "from", 'c_' || cert_hash as "to", cert_valid = 1 as valid, scan_date from hosts),
deployed_raw as (
    select 'c_' || cert_hash as "from", 'ip_' || ip as "to", cert_valid = 1 as valid, scan_date from hosts
    where cert_hash is not null
        and (error_data is null or not contains(error_data, 'invalid signature by the server certificate'))),
resolves_raw as (
    select 'd_' || domain as "from", 'ip_' || ip as "to", null::boolean as valid, scan_src, scan_date from dns
    union all select 'd_' || server_name, 'ip_' || ip, cert_valid = 1, null, scan_date from hosts),
contains_edges as (
    select distinct guid as "from", coalesce('d_' || domain_name, 'ip_' || ip) as "to" from sans),
redirects_raw as (
    select 'd_' || h.server_name as "from", 'd_' || t.target as "to", {_sanitized("t.location")} as location,
        h.cert_valid = 1 as valid, t.scan_date
    from targets t join hosts h on h.id = t.id and h.scan_date = t.scan_date
    where h.server_name is not null and t.target is not null),
parent_edges as (
    select 'd_' || domain_name as "from", 'd_' || parent as "to" from hierarchy where parent is not null)
"""


def _set(column: str) -> str:
    text = f"cast({column} as varchar)"
    return f"coalesce(string_agg(distinct {text}, ';' order by {text}), '')"


def _merged(raw: str, *sets: str) -> str:
    lists = "".join(f", {_set(c)} as {out}" for c, out in (s.split(":") for s in sets))
    return (
        f'select "from", "to", {_set("scan_date")} as scan_dates{lists}, bool_or(valid) as valid from {raw} '
        'where "from" is not null and "to" is not null group by "from", "to"'
    )


_MERGED = {
    "returns": _merged("returns_raw"),
    "deployed_on": _merged("deployed_raw"),
    "resolves": _merged("resolves_raw", "scan_src:scan_src"),
    "redirects": _merged("redirects_raw", "location:locations"),
    "contains": "select * from contains_edges",
    "parent_domain": "select * from parent_edges",
    "subdomain": 'select "to" as "from", "from" as "to" from parent_edges',
}


def _wide(name: str) -> str:
    dated = name not in ("contains", "parent_domain", "subdomain")
    return (
        f"select '{name}' as type, s.id as src, d.id as dst, "
        f"{'e.scan_dates' if dated else chr(39) * 2} as scan_dates, "
        f"{'e.scan_src' if name == 'resolves' else chr(39) * 2} as scan_src, "
        f"{'e.locations' if name == 'redirects' else chr(39) * 2} as locations, "
        f"{'e.valid' if dated else 'null::boolean'} as valid "
        f'from ({_MERGED[name]}) e join ids s on s.guid = e."from" join ids d on d.guid = e."to"'
    )


_GRAPH = f"""
vertex_keys as (
    select guid from cert_set union select 'd_' || domain_name from hierarchy union select 'ip_' || ip from ips),
ids as (select guid, row_number() over (order by guid) - 1 as id from vertex_keys),
rels as materialized ({" union all ".join(_wide(n) for n in _MERGED)}),
ends as (select src as id, 0 as i, 1 as o from rels union all select dst, 1, 0 from rels),
degree as (select id, cast(sum(i) as bigint) as inDegree, cast(sum(o) as bigint) as outDegree from ends group by id),
indexed as materialized (
    select v.id, v.guid, coalesce(d.inDegree, 0) as inDegree, coalesce(d.outDegree, 0) as outDegree
    from ids v left join degree d using (id))
"""

_SEEDS = """
seeds as (
    select 'ip' as experiment, v.id from indexed v where v.guid in (
        select 'ip_' || ip from hosts where contains(error_data, 'invalid signature by the server certificate'))
    union all
    select 'domain_name', v.id from indexed v where v.guid in (
        select 'd_' || p.host from events e, page_count c, page_hosts p
        where p.page_id = e.event_id % c.n and e.event_type = 'signup')
    union all
    select 'sha1', v.id from indexed v join cert_set s on s.guid = v.guid where s.sha1 in (
        select sha1(concat('cert', e.user_id % c.n)) from events e, page_count c
        where e.event_type = 'purchase'))
"""


_LISTED = f"""
list_rows as (
    select concat('list=', e.event_type, isodow(e.ts) - 1, case e.event_type when 'view' then '_ip'
            when 'click' then '-feodo_ip_csv' when 'purchase' then '_sha1_csv' when 'signup' then '_dn' else '_dn_csv' end) as name,
        case when e.event_type in ('view', 'click')
            then 'ip_' || concat('198.', {_spread("e.user_id")}, '.', e.event_id % 16)
            when e.event_type in ('signup', 'error') then 'd_' || p.host end as guid,
        case when e.event_type = 'purchase' then sha1(concat('cert', e.user_id % c.n)) end as sha1
    from events e, page_count c, page_hosts p where p.page_id = e.event_id % c.n)
"""


_MIRROR = """select src, dst from rels where type not in ('deployed_on', 'parent_domain')
        union select dst, src from rels where type not in ('deployed_on', 'parent_domain')"""


def _rounds(count: int, edges: str, degrees: str) -> str:
    """The definition of the scores, one pair of CTEs per round."""
    parts = [
        f"edge as materialized ({edges})",
        f"degreed as materialized ({degrees})",
        "state0 as (select distinct experiment, id, 1.0::double as score, true as fixed from seeds)",
    ]
    for t in range(count):
        echo, owed = "", "s.score"
        if t:
            echo = (
                f"left join message{t - 1} b on b.experiment = s.experiment and b.src = e.dst and b.dst = e.src"
            )
            owed = (
                "case when not s.fixed and b.score is not null and v.outDegree > 0 "
                "then s.score - b.score / v.outDegree else s.score end"
            )
        parts.append(
            f"message{t} as materialized (select s.experiment, e.src, e.dst, {owed} as score "
            f"from state{t} s join edge e on e.dst = s.id join degreed v on v.id = s.id {echo} "
            "where s.score is not null)"
        )
        parts.append(
            f"sum{t} as (select experiment, src as id, sum(score) as total from message{t} group by experiment, src)"
        )
        parts.append(
            f"state{t + 1} as materialized (select coalesce(s.experiment, m.experiment) as experiment, "
            "coalesce(s.id, m.id) as id, case when s.fixed then 1.0::double "
            "when v.outDegree > 0 then m.total / v.outDegree end as score, coalesce(s.fixed, false) as fixed "
            f"from state{t} s full join sum{t} m on m.experiment = s.experiment and m.id = s.id "
            "join degreed v on v.id = coalesce(s.id, m.id))"
        )
    return ", ".join(parts)


# Rounds that the converging run is unrolled to. It needs fewer; a list that has converged stays as it is.
CONVERGED = 12
_EPSILON = 0.01


def _converging(edges: str, degrees: str) -> str:
    """Rounds in which a list takes part until none of its scores moved by epsilon or more."""
    parts = [
        f"edge as materialized ({edges})",
        f"degreed as materialized ({degrees})",
        "state0 as (select distinct experiment, id, 1.0::double as score, 0.0::double as old_score, true as fixed from seeds)",
    ]
    for t in range(CONVERGED + 1):
        parts.append(
            f"changed{t} as materialized (select experiment, count(*) filter (abs(score - old_score) >= {_EPSILON}) "
            f"as changed from state{t} group by experiment)"
        )
        if t == CONVERGED:
            break
        parts.append(f"moving{t} as (select s.* from state{t} s join changed{t} c using (experiment) where c.changed > 0)")
        echo, owed = "", "s.score"
        if t:
            echo = f"left join message{t - 1} b on b.experiment = s.experiment and b.src = e.dst and b.dst = e.src"
            owed = (
                "case when not s.fixed and b.score is not null and v.outDegree > 0 "
                "then s.score - b.score / v.outDegree else s.score end"
            )
        parts.append(
            f"message{t} as materialized (select s.experiment, e.src, e.dst, {owed} as score "
            f"from moving{t} s join edge e on e.dst = s.id join degreed v on v.id = s.id {echo} "
            "where s.score is not null)"
        )
        parts.append(
            f"sum{t} as (select experiment, src as id, sum(score) as total from message{t} group by experiment, src)"
        )
        parts.append(
            f"state{t + 1} as materialized (select coalesce(s.experiment, m.experiment) as experiment, "
            "coalesce(s.id, m.id) as id, case when s.fixed then 1.0::double "
            "when v.outDegree > 0 then m.total / v.outDegree end as score, "
            "coalesce(s.score, 0) as old_score, coalesce(s.fixed, false) as fixed "
            f"from moving{t} s full join sum{t} m on m.experiment = s.experiment and m.id = s.id "
            "join degreed v on v.id = coalesce(s.id, m.id) "
            f"union all select s.* from state{t} s join changed{t} c using (experiment) where c.changed = 0)"
        )
    return ", ".join(parts)


def _with(*layers: str) -> str:
    return "with recursive " + ", ".join(layers) + " "


_BASE = _with(_VIEWS)
_FULL = _with(_VIEWS, _GRAPH)
_SCORED = _with(
    _VIEWS, _GRAPH, _SEEDS, _rounds(3, "select distinct src, dst from rels", "select id, outDegree from indexed")
)
_CONVERGED = _with(
    _VIEWS, _GRAPH, _SEEDS, _converging("select distinct src, dst from rels", "select id, outDegree from indexed")
)
_NEIGHBOURS = """select v.id, coalesce(n.outDegree, 0) as outDegree from indexed v
        left join (select src as id, count(*) as outDegree from edge group by src) n using (id)"""
_NEIGHBOURS_OUT = """select v.id, coalesce(n.outDegree, 0) as outDegree from indexed v
        left join (select src as id, count(distinct dst) as outDegree from rels group by src) n using (id)"""
_SCORED_DISTINCT = _with(_VIEWS, _GRAPH, _SEEDS, _rounds(3, "select distinct src, dst from rels", _NEIGHBOURS_OUT))
_DEGREE_SETS = {
    "all": "true",
    "names": "type in ('contains', 'redirects', 'parent_domain', 'subdomain')",
    "hosting": "type in ('returns', 'deployed_on', 'resolves')",
    "resolves": "type = 'resolves'",
}
_DEGREES_BY_SET = ", ".join(
    f"count(*) filter (i = {i} and {own}) as {name}{end}, "
    f"count(distinct other) filter (i = {i} and {own}) as {name}Distinct{end}"
    for name, own in _DEGREE_SETS.items()
    for end, i in (("In", 1), ("Out", 0))
)
_SCORED_BOTH = _with(_VIEWS, _GRAPH, _SEEDS, _rounds(3, _MIRROR, _NEIGHBOURS))

_ALIASES = f"""
with recursive page_hosts as (
    select page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) as host from pages),
answer as (
    select page_id, host as name, 'CNAME' as type, concat('edge', page_id % 7, '.cdn.example.net') as data from page_hosts
    union all select page_id, concat('edge', page_id % 7, '.cdn.example.net'), 'CNAME',
        concat('node', page_id % 5, '.cdn.example.net') from page_hosts
    union all select page_id, concat('node', page_id % 5, '.cdn.example.net'), 'A',
        concat('198.', {_spread("page_id")}, '.', page_id % 16) from page_hosts
    union all select page_id, concat('node', page_id % 5, '.cdn.example.net'), 'AAAA',
        concat('2001:db8::', page_id % 10000) from page_hosts
    union all select page_id, concat('loop', page_id, '.example.org'), 'CNAME', host from page_hosts
    union all select page_id, host, 'CNAME', concat('loop', page_id, '.example.org') from page_hosts),
walk as (
    select page_id, name as alias, data as at, [name] as seen from answer where type = 'CNAME' and name <> data
    union all
    select w.page_id, w.alias, a.data, list_append(w.seen, w.at)
    from walk w join answer a on a.page_id = w.page_id and a.name = w.at and a.type = 'CNAME'
        and not list_contains(list_append(w.seen, w.at), a.data))
select data as ip, name as domain, type from answer where type <> 'CNAME'
union all
select a.data, w.alias, a.type from walk w join answer a
    on a.page_id = w.page_id and a.name = w.at and a.type <> 'CNAME'
"""

ALL: dict[str, str] = {
    "ip_classes": _BASE
    + f"""select value, {_is_v4("value")} as v4, {_is_v6("value")} as v6, {_is_ip("value")} as valid from (
        select ip as value from hosts union select ip from dns union select domain || '.' from dns where scan_src = 'web-A'
        union select domain from dns where scan_src <> 'web-A' union select ip from sans)""",
    "sanitized_urls": f"select page_id, {_sanitized('url')} as url from pages",
    "sanitized_texts": f"select doc_id, {_sanitized('text')} as url from documents",
    "location_hosts": _BASE + "select id, location, target from targets",
    "domain_chains": _BASE
    + f"""select p.page_id, p.host,
        array_to_string(list_transform(range(1, len(c.labels) - c.suffix + 1),
            lambda i: array_to_string(list_slice(c.labels, i, len(c.labels)), '.')), ';') as chain,
        case when len(c.labels) - c.suffix > 1
            then array_to_string(list_slice(c.labels, 2, len(c.labels)), '.') end as parent
        from page_hosts p left join name_chains c on c.name = p.host""",
    "cert_fingerprints": "select doc_id as id, sha1(text) as sha1, sha256(text) as sha256 from documents",
    "alias_answers": _ALIASES,
    "parsed_hosts": _BASE
    + """select h.id::integer as id, h.ip, case when h.id % 3 = 0 then p.host || '.' else p.host end as server_name,
        sha256(d.text) as error_data, h.cert_hash, h.cert_valid::integer as cert_valid
        from hosts h join page_hosts p on p.page_id = h.id % (select n from page_count)
        left join documents d on d.doc_id = h.id % (select count(*) from documents)
        where h.id % 23 <> 7 and h.id % 19 <> 3""",
    "san_entries": _BASE + "select * from sans",
    "domain_names_seen": _BASE + "select * from names_seen",
    "domain_universe": _BASE + "select * from hierarchy",
    "ip_universe": _BASE + "select ip, 'ip_' || ip as guid from ips",
    "cert_universe": _BASE + "select * from cert_set",
    "dense_vertex_ids": _FULL + "select guid, id from ids",
    "dense_customer_ids": "select c_name, row_number() over (order by c_name) - 1 as id from customer",
    **{f"{name}_edges": _BASE + text for name, text in _MERGED.items()},
    "returns_with_names": _BASE
    + f"""select 'ip_' || ip as "from", 'c_' || cert_hash as "to", {_set("scan_date")} as scan_dates,
        {_set("server_name")} as server_name_indicators from hosts where cert_hash is not null group by all""",
    "redirect_locations": _BASE
    + """select distinct "from", "to", location from redirects_raw
        where "from" is not null and "to" is not null and location is not null""",
    "return_names": _BASE
    + """select distinct 'ip_' || ip as "from", 'c_' || cert_hash as "to", server_name as sni from hosts
        where ip is not null and cert_hash is not null and server_name is not null""",
    "graph_relations": _FULL + "select * from rels",
    "graph_certs": _FULL
    + """select v.id, c.* exclude (guid), v.inDegree, v.outDegree from cert_set c join indexed v using (guid)""",
    "graph_domains": _FULL
    + """select id, substring(guid, 3) as domain_name, inDegree, outDegree from indexed where starts_with(guid, 'd_')""",
    "graph_ips": _FULL
    + "select id, substring(guid, 4) as ip, inDegree, outDegree from indexed where starts_with(guid, 'ip_')",
    "graph_degrees": _FULL + "select * from degree",
    "graph_csv_round_trip": _FULL
    + r"""select src, dst, valid, place, case when place is not null then odd[place + 1] end as scan_src from (
        select src, dst, valid, odd, unnest(case when len(odd) = 0 then [null] else range(0, len(odd)) end)::integer as place
        from (select src, dst, valid, case when (src + dst) % 5 = 0 then []::varchar[] when (src + dst) % 11 = 0 then ['']
            else [concat('list; of ', (src + dst) % 7, '\s'), case when (src + dst) % 3 = 0 then '' else '\b\' end, scan_src] end as odd
            from rels where type = 'resolves'))""",
    "distinct_degrees": _FULL
    + f"""select id, {_DEGREES_BY_SET} from (select src as id, dst as other, type, 0 as i from rels
        union all select dst, src, type, 1 from rels) group by id""",
    "scores_3_rounds_distinct": _SCORED_DISTINCT
    + "select experiment, id, round(score, 8) as score, fixed from state3",
    "graph_undirected_degrees": _FULL + "select id, count(*) as degree from ends group by id",
    "graph_vertex_union": _FULL + "select id, inDegree, outDegree from indexed",
    "typed_edges": _FULL + "select src, dst, type from rels",
    "reverse_valid_edges": _FULL
    + "select dst as src, src as dst, scan_dates from rels where type = 'resolves' and valid",
    "mirrored_edges": _FULL + _MIRROR,
    "mirrored_degrees": _with(_VIEWS, _GRAPH, f"edge as ({_MIRROR})") + _NEIGHBOURS,
    "trade_degrees": """select id, cast(sum(i) as bigint) as inDegree, cast(sum(o) as bigint) as outDegree from (
        select 'p' || l_partkey as id, 0 as i, 1 as o from lineitem
        union all select 's' || l_suppkey, 1, 0 from lineitem) group by id""",
    "listed_vertices": _with(_VIEWS, _GRAPH, _LISTED)
    + """select distinct l.name as experiment, v.id from list_rows l join cert_set s using (sha1) join indexed v on v.guid = s.guid
        union select l.name, v.id from list_rows l join indexed v using (guid)""",
    "blocklist_seeds": _with(_VIEWS, _GRAPH, _SEEDS) + "select * from seeds",
    "scores_3_rounds": _SCORED
    + "select experiment, guid as name, round(score, 8) as score, fixed from state3 join indexed using (id)",
    "scores_3_rounds_both_ways": _SCORED_BOTH
    + "select experiment, id, round(score, 8) as score, fixed from state3",
    "score_histogram_3_rounds": _SCORED
    + """select experiment, round(round(score, 8), 1) as score_bucket, count(*) as vertices
        from state3 where not fixed group by all""",
    "score_anomalies_3_rounds": _SCORED
    + "select experiment, id, round(score, 8) as score, fixed from state3 where score > 1.0",
    "score_anomalies_planted": _with(
        _VIEWS, _GRAPH, _SEEDS, _rounds(3, "select distinct src, dst from rels", "select id, 1 as outDegree from indexed")
    )
    + "select experiment, id, round(score, 8) as score, fixed from state3 where score > 1.0",
    "scores_converged": _CONVERGED
    + f"""select experiment, guid as name, round(score, 8) as score, fixed
        from state{CONVERGED} join indexed using (id)""",
    # A list has a row for each round up to the first in which nothing moved, and the last of all lists.
    "rounds_changed": _CONVERGED
    + "select experiment, round, changed from ("
    + " union all ".join(f"select experiment, {t} as round, changed from changed{t}" for t in range(CONVERGED + 1))
    + """) qualify coalesce(max(changed = 0) over (partition by experiment order by round
        rows between unbounded preceding and 1 preceding), false) = false""",
    "affected_3_rounds": _SCORED
    + "select experiment, count(*) filter (score > 0) as affected from state3 group by experiment",
    "ip_scores_3_rounds": _SCORED
    + """select v.id, substring(v.guid, 4) as ip, v.inDegree, v.outDegree, s.experiment,
        round(s.score, 8) as score, s.fixed from indexed v join state3 s using (id) where starts_with(v.guid, 'ip_')""",
}

# What is stopped and resumed, or written and read back, must be what it is without that.
ALL["scores_by_changes"] = ALL["scores_resumed"] = ALL["stored_scores"] = ALL["scores_converged"]
ALL["stored_graph_edges"] = ALL["typed_edges"]
