"""SQL of the operators whose whole result SQL can express: exact pairs and their components."""

from __future__ import annotations

COMPONENTS = "r(a, b) as (select a, a from n union select r.a, e.b from r join e on r.b = e.a), c as (select a, min(b) as b from r group by 1)"

#: All pairs by cosine, in double precision; a brute-force join of the whole table.
EMBEDDING_DEDUP = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    e as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and list_cosine_similarity(x.v, y.v) >= 0.9),
    n as (select vec_id as a from v), {COMPONENTS}
    select c.a as vec_id, (select count(*) from e where e.a = c.a) as n_links, c.b as component_id, c.a = c.b as kept from c"""

#: All pairs of documents with a common shingle.
JACCARD_JOIN = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
    k as (select w.doc_id, count(s.s) as k from w left join s using (doc_id) group by 1),
    p as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
    h as (select p.a, p.b from p join k x on x.doc_id = p.a join k y on y.doc_id = p.b where 100 * o >= 85 * (x.k + y.k - o)),
    e as (select a, b from h union all select b, a from h), n as (select doc_id as a from k), {COMPONENTS}
    select c.a as doc_id, k.k as n_shingles, c.b as component_id from c join k on k.doc_id = c.a"""

#: Five filters replayed in the 120 orders, by document and order.
FILTER_AUDIT = """with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    m as (select text, min(doc_id) as least from t group by 1),
    l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by 1),
    d as (select part, concat(case when len(w) < 100 then 'A' end, case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' end,
            case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) then 'C' end, case when regexp_matches(t.text, '[#$%&*|]') then 'D' end,
            case when t.doc_id > m.least then 'E' end) as fails, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic
        from t join m using (text) left join l on l.doc_id = t.doc_id),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    o as (select concat(a.x, b.x, c.x, d.x, e.x) as filter_order from x a, x b, x c, x d, x e
        where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select part, fails, good, toxic, filter_order, cast(step as integer) as step, filter_order[step] as letter, contains(fails, filter_order[step]) as fails_here,
            length(translate(filter_order[1:step - 1], fails, '')) < step - 1 as gone from d, o, range(1, 6) r(step)),
    g as (select part, filter_order, step, any_value(letter) as letter, count(*) filter (not gone and not fails_here) as kept, count(*) filter (not gone and fails_here) as removed,
            count(*) filter (gone and fails_here) as redundant, count(*) filter (fails = letter) as unique_fails, count(*) filter (not gone and fails_here and good) as good_lost,
            count(*) filter (not gone and fails_here and toxic) as toxic_lost from s group by 1, 2, 3)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from g"""

#: Every kept term for every group and language, then all pairs of a language's groups term by term.
SOURCE_DIVERGENCE = """with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
    t as (select r, lang, source, unnest(w) as term from d),
    k as (select lang, term, count(*) as cl from t group by 1, 2 having count(distinct r) >= 3),
    l as (select lang, count(*) as v, cast(sum(cl) as hugeint) as nl from k group by 1),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as c from t semi join k using (lang, term) group by 1, 2, 3),
    n as (select g.lang, g.source, cast(coalesce(sum(c.c), 0) as hugeint) as n from g left join c using (lang, source) group by 1, 2),
    e as (select n.lang, n.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (n.n + l.v) as p, 1 + (1000000000::hugeint * (k.cl + 1)) // (l.nl + l.v) as q
        from n join k using (lang) join l using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join e x on x.lang = a.lang and x.source = a.source left join e y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
    terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from e where c > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200"""

ORACLE_SQL = {"op11_source_divergence": SOURCE_DIVERGENCE, "op13_filter_audit": FILTER_AUDIT, "op4_embedding_dedup": EMBEDDING_DEDUP, "op9_jaccard_join": JACCARD_JOIN}
