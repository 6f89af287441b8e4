"""SQL equal to the queries of catalog.py, for another engine (RE2 patterns, no look-around).

page_links has none: it needs relative addresses; it is tested on small inputs.
The greedy matching walks each building's sorted pairs by recursion.
"""

from __future__ import annotations

from hearthline.functions import text as T
from hearthline.plans import histories, landed, mixed, trips
from hearthline.plans.catalog import AGG, UP, _duck
from hearthline.sources import htmlx

L, O, A, Q, M, S = (_duck(x) for x in ("listings", "observations", "addresses", "quotes", "messages", "searches"))


def _map(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _q(text: str) -> str:
    return text.replace("'", "''")


def _cases(column: str, pairs: list[tuple[str, str]]) -> str:
    return "coalesce(" + ", ".join(f"case when contains({column}, '{_q(a)}') then '{_q(b)}' end" for a, b in pairs) + ")"


def _street(column: str) -> str:
    s = f"regexp_replace(regexp_replace(replace(lower({column}), '&', ' and '), '[.,]', ' ', 'g'), '[^\\w\\s-]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b(\\d+)(st|nd|rd|th)\\b', '\\1', 'g')"
    words = f"list_filter(string_split_regex({s}, '\\s+'), lambda x: x <> '')"
    turn = f"list_transform(list_transform({words}, lambda x: coalesce({_map(T.DIRECTIONS)}[x], x)), lambda x: coalesce({_map(T.STREET_TYPES)}[x], x))"
    return f"coalesce(array_to_string({turn}, ' '), '')"


BOROUGH = lambda c: _cases(f"lower({c})", [(b.lower(), b) for b in T.BOROUGHS] + list(T.NEIGHBORHOODS.items()))
ZIP = "coalesce(" + ", ".join(f"case when cast(zip as int) between {a} and {b} then '{n}' end" for a, b, n in T.ZIP_RANGES) + ")"
UNIT = "regexp_replace(regexp_replace(regexp_replace(upper(unit), '(?i)\\b(apartment|apt|unit|suite|ste|residence|res|no|number|#)\\b\\.?\\s*', '', 'g'), '[^A-Z0-9]', '', 'g'), '^0+(\\d)', '\\1')"
REGISTER = f"upper(array_to_string(list_transform(string_split({_street('''regexp_replace(street, '^\\s*(\\d[\\w-]*)\\s+', '')''')}, ' '), lambda x: coalesce({_map(T.LONG_FORMS)}[x], x)), ' '))"
KEY = f"trim(concat_ws(' ', {_street('street')}, coalesce({BOROUGH('place')}, {BOROUGH('street')}, trim(place), '')))"
LEAD = f"""(select source as aggregator, case when sqft // 40 % 3 <> 0 then (sqft // 40 * 37 % 400 - 120) / 4.0 end as lead_hours, first_seen,
        case when sqft // 40 % 7 = 0 then 'censored:present-at-first-crawl' when sqft // 40 % 5 = 0 then 'listed_at->first_seen' when listed_at is null then 'first_seen->first_seen' else 'listed_at->listed_at' end as basis from {L})"""
SAME = "(not starts_with(basis, 'censored:') and split_part(basis, '->', 1) = split_part(basis, '->', 2))"
USE = f"(lead_hours is not null and {SAME})"
RANK = lambda c: f"case {c} when 'high' then 2 when 'medium' then 1 else 0 end"

DISTRIBUTION = f"""select count(*) filter ({USE}) as measured, count(*) filter (lead_hours is null) as pending, count(*) filter (lead_hours is not null and not coalesce({SAME}, false)) as excluded_mixed_basis,
    round_even(median(lead_hours) filter ({USE}), 1) as median_hours, round_even(avg(lead_hours) filter ({USE}), 1) as mean_hours,
    round_even(list_sort(list(lead_hours) filter ({USE}))[greatest(1, cast(floor(count(*) filter ({USE}) * cast(0.1 as double)) as bigint))], 1) as p10_hours,
    round_even(list_sort(list(lead_hours) filter ({USE}))[least(count(*) filter ({USE}), cast(floor(count(*) filter ({USE}) * cast(0.9 as double)) as bigint) + 1)], 1) as p90_hours,
    round_even(avg(cast(lead_hours > 0 as int)) filter ({USE}), 3) as share_ahead, round_even(avg(cast(lead_hours >= 24 as int)) filter ({USE}), 3) as share_ahead_24h, round_even(avg(cast(lead_hours >= 72 as int)) filter ({USE}), 3) as share_ahead_72h,
    case when count(*) filter ({USE}) between 1 and 29 then 'small sample' end as caveat,
    case when count(*) filter ({USE}) = 0 and count(*) filter (lead_hours is not null) > 0 then concat(count(*) filter (lead_hours is not null), ' pairs found, none of them usable yet') when count(*) filter ({USE}) = 0 then 'no aggregator timestamps recorded yet' end as note from t"""
#: The one-to-one choice: each building's pairs in order, a pair taken if neither side is yet.
MATCHES = f"""with recursive x as (select *, coalesce(nullif(bin, ''), nullif(bbl, '')) as building from {L} where price is not null),
    c as (select u.building, u.fingerprint as u_fp, a.fingerprint as a_fp, u.source as u_source, case when u.price = a.price then 'building+beds+price' else 'building+beds+near-price' end as matched_by,
            case when u.price = a.price then 0.0 else abs(u.price - a.price) / cast(greatest(u.price, a.price) as double) end as penalty, coalesce(u.listed_at, u.first_seen) as u_time, coalesce(a.listed_at, a.first_seen) as a_time,
            u.listed_at is not null as u_listed, a.listed_at is not null as a_listed, u.first_seen as u_seen
        from x u join x a on u.building = a.building and u.source in ({_list(UP)}) and a.source in ({_list(AGG)}) and coalesce(abs(u.beds - a.beds) <= 0.01, true) and abs(u.price - a.price) / cast(greatest(u.price, a.price) as double) <= 0.04),
    o as (select *, row_number() over (partition by building order by penalty, u_fp, a_fp) as k from c),
    g(building, k, ups, aggs, hit) as (select distinct building, cast(0 as bigint), cast([] as varchar[]), cast([] as varchar[]), false from o
        union all select g.building, o.k, case when not list_contains(ups, u_fp) and not list_contains(aggs, a_fp) then list_append(ups, u_fp) else ups end, case when not list_contains(ups, u_fp) and not list_contains(aggs, a_fp) then list_append(aggs, a_fp) else aggs end,
            not list_contains(ups, u_fp) and not list_contains(aggs, a_fp) from g join o on o.building = g.building and o.k = g.k + 1),
    m as (select o.*, date_diff('hour', u_time, a_time) as lead,
            case when not u_listed and (u_source = 'up2' or (u_source = 'up0' and u_seen < timestamp '1995-06-01 00:00:00')) then 'censored:present-at-first-crawl' else concat(case when u_listed then 'listed_at' else 'first_seen' end, '->', case when a_listed then 'listed_at' else 'first_seen' end) end as basis
        from g join o using (building, k) where hit)"""

ORACLES: dict[str, str] = {
    "text_fields": f"""select c_custkey, {_street('street')} as street, {UNIT} as unit, regexp_extract(street, '^\\s*(\\d{{1,4}}(?:-\\d{{1,3}})?)\\b', 1) as house,
        {BOROUGH('place')} as borough, {ZIP} as zip_borough, {REGISTER} as register_street from {A}""",
    "numbers": f"""with t as (select *, regexp_replace(rent, '[^0-9.]', '', 'g') as digits, case when o_orderkey % 5 = 0 then 0.0 when o_orderkey % 5 = 1 then o_custkey % 15 + 0.5 when o_orderkey % 5 = 2 then o_custkey % 4 when o_orderkey % 5 = 3 then o_custkey % 20 end as b,
            case when len(cast(o_custkey % 30000 as varchar)) >= 3 then o_custkey % 30000 end as a from (select q.*, o_custkey from {Q} q join orders using (o_orderkey)))
        select o_orderkey, cast(case when not regexp_matches(digits, '\\..*\\.') and cast(digits as double) between 500 and 100000 then round_even(cast(digits as double), 0) end as int) as price,
            cast(case when b between 0 and 12 then b end as double) as beds, cast(case when a between 80 and 20000 then a end as int) as sqft from t""",
    "stamps": f"""select o_orderkey, cast(case o_orderkey % 4 when 0 then 0 when 1 then 24 when 2 then o_custkey % 40 else (o_custkey % 9) * 168 end as double) as hours_ago, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 1 then strftime(o_orderdate, '%Y-%m-%d 06:30:00') end as stamp from orders""",
    "fingerprints": f"""with t as (select *, coalesce(nullif(bin, ''), nullif(bbl, '')) as b, nullif(unit_key, '') as u, case when sqft > 1000 then concat('ref:', source, ':', fingerprint) end as r, coalesce(cast(beds as varchar), '') as bs from {L})
        select fingerprint, substr(sha1(case when b is not null and u is not null then concat(b, '|', u) when b is not null and r is not null then concat(b, '|', r) when b is not null then concat(b, '||', bs)
            else concat('nobbl|', {_street('address')}, '|', coalesce(u, r, ''), '|', bs) end), 1, 20) as identity from t""",
    "titles": f"""select c_custkey, {UNIT.replace('upper(unit)', "upper(regexp_replace(regexp_replace(unit, '^[A-Za-z]+[. ]*', ''), '-b$', ''))")} as unit from {A}""",  # an unmarked token ends at a dash
    "normalized": f"""with r as (select *, {KEY} as query, {UNIT} as u, c_custkey % 9000 + 400 as rent from {A}),
        n as (select *, len(query) % 3 <> 0 as hit from r)
        select case when hit then 'high' else 'low' end as confidence, case when hit then 'Queens' else place end as borough, count(*) as n,
            count(distinct case when hit then concat(md5(query), '|', u) else concat('nobbl|', {_street('street')}, '|', u, '|1.0') end) as units, cast(sum(case when rent >= 500 then rent end) as bigint) as rents from n group by 1, 2""",
    "geo_lookup": f"""with k as (select {KEY} as query, min(c_custkey) as k from {A} group by 1),
        o as (select case when k % 2 = 0 then (case when k % 5 = 0 then 'negative' else 'hit' end) when k % 3 = 0 then 'empty' when k % 5 <= 1 then 'low' else 'resolved' end as outcome from k where query <> '')
        select outcome, count(*) as n, count(case when outcome in ('hit', 'resolved') then 1 end) as with_bbl from o group by 1""",
    "active_listings": f"select fingerprint, price, beds, first_seen from {L} where gone_at is null and price <= 4000 and beds >= 1 and borough = 'Queens' order by first_seen desc, fingerprint limit 200",
    "new_since": f"select source, count(*) as n, max(first_seen) as newest from {L} where gone_at is null and first_seen > timestamp '1998-01-01 00:00:00' group by 1",
    "summary": f"""select count(*) as listings_total, count(case when gone_at is null then 1 end) as listings_active, count(bbl) as with_bbl, count(case when unit_key <> '' then 1 end) as with_unit,
        count(case when confidence = 'high' then 1 end) as high_confidence, count(distinct bbl) as distinct_buildings, (select count(*) from events) as events from {L}""",
    "criteria": f"""with j as (select s.name as search, case when {RANK('l.confidence')} < {RANK('s.min_confidence')} then 'below confidence floor' when s.max_price is not null and l.price is null then 'no price published'
            when s.max_price is not null and l.price > s.max_price then concat('price ', l.price, ' > ', s.max_price) when s.min_beds is not null and (l.beds is null or l.beds < s.min_beds) then 'too few bedrooms'
            when s.max_beds is not null and l.beds > s.max_beds then 'more bedrooms than requested' when len(s.boroughs) > 0 and not coalesce(list_contains(s.boroughs, l.borough), false) then concat('borough ', coalesce(l.borough, 'None'))
            when coalesce(s.require_no_fee, false) and not coalesce(l.no_fee, false) then 'not confirmed no-fee' when s.min_sqft is not null and (l.sqft is null or l.sqft < s.min_sqft) then 'under minimum square footage' end as reject,
            concat_ws(', ', case when s.max_price is not null then concat('$', format('{{:,}}', l.price), '/mo within budget') end, case when l.beds is not null then concat(cast(cast(l.beds as int) as varchar), ' bed') end, case when len(s.boroughs) > 0 then l.borough end) as reasons
            from {L} l cross join {S} s)
        select search, coalesce(reject, reasons) as verdict, count(*) as n from j group by 1, 2""",
    "second_run": "select source, max(case when k = 2 then d end) as second_run from (select event_type as source, cast(ts as date) as d, row_number() over (partition by event_type order by cast(ts as date)) as k from (select distinct event_type, cast(ts as date) as ts from events)) group by 1",
    "cdc_events": f"""with o as {O}, r as (select source, crawl, row_number() over w as run, lead(crawl) over w as next_crawl from (select distinct source, crawl from o) window w as (partition by source order by crawl)),
        x as (select o.*, r.run, r.next_crawl from o join r using (source, crawl)),
        y as (select *, last_value(price ignore nulls) over (partition by fingerprint order by run, ordinal rows between unbounded preceding and 1 preceding) as old_price,
              lag(run) over v as before, lead(run) over v as after from x window v as (partition by fingerprint order by run, ordinal))
        select fingerprint, source, 'new' as event, crawl, cast(null as int) as old_price, price as new_price from y where before is null
        union all select fingerprint, source, 'relisted', crawl, old_price, price from y where run - before > 1
        union all select fingerprint, source, 'price_change', crawl, old_price, price from y where before is not null and price <> old_price
        union all select fingerprint, source, 'gone', next_crawl, null, null from y where next_crawl is not null and coalesce(after - run > 1, true)""",
    "cdc_verdicts": f"""with o as {O}, l as (select max(crawl) as last from o),
        s as (select fingerprint, arg_max(price, struct_pack(c := crawl, o := ordinal)) filter (price is not null) as p, max(crawl) < (select last from l) - 1 as gone from o, l where crawl < last group by 1),
        b as (select fingerprint, price, row_number() over (partition by fingerprint order by ordinal) as ordinal from o, l where crawl = last),
        y as (select b.*, s.fingerprint is not null as known, coalesce(s.gone, false) as gone, coalesce(last_value(b.price ignore nulls) over (partition by b.fingerprint order by b.ordinal rows between unbounded preceding and 1 preceding), s.p) as old_price from b left join s using (fingerprint))
        select fingerprint, cast(ordinal as int) as ordinal, old_price, price, case when ordinal = 1 and not known then 'new' when ordinal = 1 and gone then 'relisted' when price <> old_price then 'price_change' else 'seen' end as verdict from y""",
    "mark_gone": f"with o as {O}, l as (select max(crawl) as last from o) select distinct fingerprint from o, l where crawl = last - 1 and fingerprint not in (select fingerprint from o, l where crawl = last)",
    "match_candidates": f"""with x as (select *, coalesce(nullif(bin, ''), nullif(bbl, '')) as building from {L} where price is not null)
        select u.building, u.fingerprint as u_fp, a.fingerprint as a_fp, case when u.price = a.price then 'building+beds+price' else 'building+beds+near-price' end as matched_by,
            round(case when u.price = a.price then 0.0 else abs(u.price - a.price) / cast(greatest(u.price, a.price) as double) end, 9) as penalty
        from x u join x a on u.building = a.building and u.source in ({_list(UP)}) and a.source in ({_list(AGG)}) and coalesce(abs(u.beds - a.beds) <= 0.01, true) and abs(u.price - a.price) / cast(greatest(u.price, a.price) as double) <= 0.04""",
    "lead_distribution": f"with t as {LEAD} {DISTRIBUTION}",
    "greedy_match": f"{MATCHES} select building, u_fp as upstream_fp, a_fp as aggregator_fp, matched_by, basis from m",
    "match_counters": f"{MATCHES} select count(*) as pairs_found, count(*) filter (abs(lead) <= 60 * 24) as recorded, 0 as already_measured, 0 as unusable, count(*) filter (abs(lead) > 60 * 24) as implausible, count(*) filter (matched_by = 'building+beds+price') as exact_price from m",
    "match_counters_again": f"""{MATCHES} select count(*) as pairs_found, 0 as recorded, count(*) filter (abs(lead) <= 60 * 24 and u_fp >= '8') as already_measured,
        count(*) filter (abs(lead) <= 60 * 24 and u_fp < '8') as unusable, count(*) filter (abs(lead) > 60 * 24) as implausible, count(*) filter (matched_by = 'building+beds+price') as exact_price from m""",
    "lead_report": f"""{MATCHES}, t as (select case when abs(m.lead) <= 60 * 24 then cast(m.lead as double) end as lead_hours, m.basis from (select distinct fingerprint from {L} where source in ({_list(UP)})) b left join m on m.u_fp = b.fingerprint) {DISTRIBUTION}""",
    "page_markup": "select concat('https://x.example/', p_partkey) as source_url, concat(p_partkey, ' Elm St') as address, p_retailprice as price, p_name as title from part",
    "lead_by_basis": f"with t as {LEAD} select basis, count(*) as n from t where {USE} group by 1",
    "lead_by_aggregator": f"with t as {LEAD} select aggregator, count(*) as n from t where lead_hours is not null group by 1",
    # addresses of the pages are absolute or begin at the site's root, without dots
    "page_anchors": f"""select page_id, cast(pos as int) as pos, href, regexp_replace(case when starts_with(href, '/') then concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), href) else href end, '[?#].*$', '') as link
        from (select page_id, url, unnest(generate_series(0, len(h) - 1)) as pos, unnest(h) as href from (select page_id, url, regexp_extract_all(html, '{htmlx.ANCHOR}', 1) as h from pages))
        where starts_with(href, '/') or starts_with(href, 'http')""",
    # the two links that the query adds to each page are all that score; numbers of five digits aren't house numbers
    "page_links": """with p as (select url, page_id < 10000 as house, regexp_extract(url, '^[a-z]+://[^/?#]*') as root, cast(page_id as varchar) as k from pages),
        t as (select *, root || '/available-apartments/' || k as flats, root || '/buildings/' || k || '-main-st' as building, k || ' East 21st Street' as name from p)
        select url, flats as link, 'Available apartments' as label, 9 as score, 1 as place from t
        union all select url, building, name, case when house then 9 else 4 end, 1 from t union all select url, flats, 'Available apartments', 1, 2 from t
        union all select url, building, name, case when house then 13 else 6 end, 1 from t union all select url, flats, 'Available apartments', 2, 2 from t""",
    "page_counts": f"""select page_id, cast(len(list_distinct(regexp_extract_all(html, '{htmlx.RENT_IN_PAGE}'))) as int) as prices, cast(len(regexp_extract_all(html, '{htmlx.BED_IN_PAGE}')) as int) as beds,
        cast(len(regexp_extract_all(html, '{htmlx.UNIT_IN_PAGE}')) as int) as units from pages""",
    "page_verdicts": f"""select concat(url, '#', page_id) as url, case when v then 'PMS' when length(html) // 1024 < 40 then 'SPA' else 'HTML' end as verdict, case when v then 1 when length(html) // 1024 < 40 then 2 else 3 end as rank
        from (select *, regexp_matches(lower(html), '\\b({"|".join(htmlx.VENDOR_TOKENS)})\\.(com|net|us|io)\\b') as v from pages)""",
    "verdict_totals": f"""select verdict, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from (select case when regexp_matches(lower(html), '\\b({"|".join(htmlx.VENDOR_TOKENS)})\\.(com|net|us|io)\\b') then 'PMS' when length(html) // 1024 < 40 then 'SPA' else 'HTML' end as verdict from pages) group by 1""",
    "page_details": """select concat(page_id, ' Water Street') as address, concat(page_id, 'A') as unit_raw, concat('4,', lpad(cast(page_id as varchar), 3, '0')) as price_raw, '2 Beds' as beds_raw, '1.5' as baths_raw, 'Manhattan' as borough_hint, '2' as months_free from pages""",
    "social": f"""with t as (select *, concat(title, chr(10), body) as x from {M})
        select conv_id, turn, turn % 3 <> 0 as offer, list_min(list_filter(list_transform(regexp_extract_all(x, '\\$\\s?([1-9][\\d,]{{2,6}})', 1), lambda p: try_cast(replace(p, ',', '') as int)), lambda p: p between 500 and 30000)) as price,
            nullif(regexp_extract(x, '(?i)\\b(studio|\\d+\\s*(?:bed\\s?rooms?|beds?|br|bd))\\b', 1), '') as beds, {_cases('lower(x)', [(p, p) for p in T.POST_PLACES])} as neighborhood from t""",
    "json_dig": "select event_id, cast(json_extract_string(props, '$.k') as int) as k, cast(null as varchar) as missing from events",
    "json_records": """select cast(l_orderkey as varchar) as payload, concat(l_partkey, ' Elm St') as address, cast(l_linenumber as varchar) as unit_raw, cast(l_partkey % 9000 + 1000 as int) as price
        from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 3)""",
    "survey_rank": "select s_name as name, case s_suppkey % 4 when 0 then 'JSONLD' when 1 then 'PMS' when 2 then 'HTML' else 'DEAD' end as verdict, cast(row_number() over (order by case s_suppkey % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 5 end, lower(s_name), s_name) as int) as place from supplier",
    "queue_slice": "select s_suppkey as seq, s_name, 'Acme PMS' as vendor from supplier where s_nationkey % 2 = 0 order by s_suppkey limit 20 offset 5",
}
ORACLES |= landed.EXPECTED | histories.EXPECTED | mixed.EXPECTED | trips.EXPECTED
ORACLES |= {
    "stream_events": ORACLES["cdc_events"],
    "fresh_leads": f"{MATCHES} select u_fp as upstream_fp, cast(lead as double) as lead_hours from m where abs(lead) <= 60 * 24 order by lead desc, u_fp limit 20",
    "generated_entries": f"""with e as ({landed.EXPECTED["endpoints"]}) select concat('found_', substr(sha1(url), 1, 8)) as id, 'jsonapi' as type, url, true as enabled,
        case when score - n_records // 10 = 11 then 'address,price,unit_raw' else 'address,beds,price,unit_raw' end as fields, concat('auto-discovered; ', n_records, ' records, score ', score) as notes from e""",
}
