"""DuckDB SQL for the operators whose results SQL can express, over the whole tables."""

from __future__ import annotations

#: Words between white space, and the row's place in its document's words.
WORDS = r"""
own as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
word as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from own)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
with sized as (
    select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
    select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as most from totals
),
levels as (
    select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (o rows between current row and unbounded following) as level
    from weighed window o as (order by most / w, source nulls last)
),
held as (select level from levels where level * w <= most order by most / w, level limit 1),
plan as (select source, source_size, least(most, w * coalesce((select level from held), 'inf'::double)) as target from levels),
budget as (
    select *, case when source_size > 0 then floor(round(target) / source_size) else 0 end::bigint as epochs from plan
),
keyed as (
    select s.*, b.source_size, b.target, b.epochs, round(b.target)::bigint - b.epochs * b.source_size as rest,
        ln(-ln((('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 1) / 4503599627370496.0::double * (1 - 1 / 4503599627370496.0::double))
            / greatest(len(list_distinct(lines))::double / greatest(len(lines), 1) * (1 - least(len(regexp_extract_all(text, '[#*$%&|<>]'))::double / greatest(size, 1), 1.0::double))
                * least(length(text)::double / greatest(size, 1) / 6, 6 / (length(text)::double / greatest(size, 1))), 0.01::double)) as key
    from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from sized) s join budget b on s.source is not distinct from b.source
),
taken as (
    select *, greatest(0, least(size, rest - (sum(size) over (partition by source order by key, doc_id rows unbounded preceding) - size))) as part from keyed where size > 0
)
select doc_id, size, source_size, target, (epochs * size + part)::bigint as taken from taken
union all select doc_id, size, source_size, target, 0 from keyed where size = 0
"""

OP2 = rf"""
with recursive own as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
word as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from own where len(w) >= 5),
five as (select doc_id, list(word) over (partition by doc_id order by p rows between current row and 4 following) as g from word),
shingle as (
    select distinct doc_id, array_to_string(g, ' ') as g from five where len(g) = 5
    union all select doc_id, array_to_string(w, ' ') from own where len(w) between 1 and 4
),
sized as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingle a join shingle b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (
    select a, b from pair join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
),
edge as (select a, b from link union all select b, a from link),
reach(id, c) as (select doc_id, doc_id from documents union select e.b, r.c from reach r join edge e on e.a = r.id),
least_id as (select id, min(c) as c from reach group by id)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.c as component_id, d.doc_id = l.c as kept
from documents d join least_id l on l.id = d.doc_id left join sized s on s.doc_id = d.doc_id
"""

OP3 = rf"""
with {WORDS},
run as (select doc_id, p, word, list(word) over (partition by doc_id order by p rows between current row and 19 following) as g from word),
keyed as (select doc_id, p, word, case when len(g) = 20 then array_to_string(g, ' ') end as g from run),
again as (select doc_id, p, word, g is not null and row_number() over (partition by g order by doc_id, p) > 1 as again from keyed),
cut as (
    select doc_id, p, word, bool_or(again) over (partition by doc_id order by p rows between 19 preceding and current row) as gone from again
),
kept as (
    select doc_id, count(*)::bigint as n_words, count(*) filter (gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by p) filter (not gone), '') as kept
    from cut group by doc_id
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept using (doc_id)
"""

OP7 = rf"""
with own as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
iword as (select item_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as p from item),
irun as (select item_id, n, p, list(word) over (partition by item_id order by p rows between current row and 12 following) as g from iword),
iwin as (select distinct item_id, len(g) as k, array_to_string(g, ' ') as g from irun where len(g) = 13 or (n < 13 and p = 1)),
dword as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from own),
drun as (select doc_id, p, list(word) over (partition by doc_id order by p rows between current row and 12 following) as g from dword),
dwin as (select doc_id, p, k, array_to_string(g[1:k], ' ') as g from drun join (select distinct k from iwin) on len(drun.g) >= k),
hit as (select doc_id, p, k, item_id from dwin join iwin using (k, g)),
place as (select distinct doc_id, unnest(range(p, p + k)) as p from (select distinct doc_id, p, k from hit)),
hits as (select doc_id, count(*) as n_hit from place group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id
)
select o.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from own o left join hits using (doc_id) left join items using (doc_id)
"""

OP11 = r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
own as (
    select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path
    from cut
),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
    select page_id, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
    from (select distinct * from own) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select o.page_id, host, path, rule,
    coalesce(verdict, case when regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|porn|spam)([.-]|$)') then 'block' else 'allow' end) as verdict
from own o left join fits f on o.page_id = f.page_id
"""

OP12 = r"""
with own as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id::varchar) as x from documents
),
drawn as (
    select *, len(u)::bigint as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 25, 8))::bigint as h4 from own
),
placed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from drawn),
formed as (
    select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
        array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf
    from placed
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then text when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
    sha256(text) as restored_sha256
from formed
"""
