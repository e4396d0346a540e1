"""SQL (DuckDB) that gives the rows of a query where SQL can say them. The others are tested against brute force."""

from __future__ import annotations

#: Fixed patterns of the contracts.
_SPACE, _NOT_WORD = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex({text}, '{separators}'), lambda x: x <> '')"


EXACT = rf"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') as norm, length(coalesce(text, '')) as n from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over w = 1 as kept, sha256(norm) as text_sha256
from t window w as (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following)
"""

CONTAMINATION = rf"""
with d as materialized (select row_number() over () as r, doc_id, {_words(_LOWER, _NOT_WORD)} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_words(_LOWER, _NOT_WORD)} as w from benchmark),
runs as materialized (select row_number() over () as k, item, least(len(w), 10) as n, list_slice(w, s, s + least(len(w), 10) - 1) as v
  from b, unnest(range(1, greatest(len(w) - 8, 2))) as u(s) where len(w) > 0),
windows as (select distinct item, n, array_to_string(v, ' ') as g from runs),
places as (select r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g
  from d, (select distinct n from windows) as l, unnest(range(1, len(w) - n + 2)) as u(s) where len(w) >= n),
hits as (select p.r, p.s, p.n, v.item from places p join windows v on p.n = v.n and p.g = v.g),
covered as (select r, count(distinct pos) as n_hit from (select r, unnest(range(s, s + n)) as pos from hits) group by 1),
items as (select r, list_sort(list(distinct item)) as items from hits group by 1),
-- proximity: around each place of a run's rarest word, all stretches of its length and five more words
token as materialized (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as pos from d),
need as (select k, x, count(*) as m from (select k, unnest(v) as x from runs) group by 1, 2),
freq as (select x, count(*) as f from token group by 1),
rare as (select k, arg_min(x, (coalesce(f, 0), x)) as x from need left join freq using (x) group by 1),
anchor as (select k, r, pos as p, n from rare join token using (x) join runs using (k)),
around as (select k, r, p, n, t.pos, t.x, m from anchor join token t using (r) join need using (k) where t.x = need.x and t.pos between p - n - 4 and p + n + 4),
stretch as (select k, r, p, n, a, x, least(count(*), any_value(m)) as c from around, unnest(range(p - n - 4, p + 1)) as u(a) where pos between a and a + n + 4 group by all),
complete as (select distinct k, r from (select k, r, p, a, n from stretch group by all having sum(c) = n)),
near as (select r, count(distinct item) as n_near from complete join runs using (k) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join covered c using (r) left join items i using (r) left join near using (r)
"""

REPEATS = rf"""
with d as (select doc_id, {_words("coalesce(text, '')", _SPACE)} as w from documents),
places as (select doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') as g from d, unnest(range(1, len(w) - 33)) as u(s) where len(w) >= 35),
again as (select g from places group by 1 having count(*) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 35)) as pos from places semi join again using (g)),
flat as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select doc_id, string_agg(word, ' ' order by pos) as kept, count(*) as n from flat anti join gone using (doc_id, pos) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept k on d.doc_id = k.doc_id
"""


def _places(table: str, kind: str, order: int, pattern: str, flags: str = "") -> str:
    """Select of (r, kind, o, s, e, v, before, after): all matches of a pattern with their places in code points, from the lengths of matches and of the pieces between them."""
    flags = f", '{flags}'" if flags else ""
    pattern = pattern.replace("'", "''")
    return f"""select r, '{kind}' as kind, {order} as o, cast(z - length(m) as bigint) as s, cast(z as bigint) as e, m as v, before, after from (
  select r, m, before, after, sum(length(before) + length(m)) over (partition by r order by i) as z from (
  select r, unnest(ms) as m, unnest(ps[1:len(ms)]) as before, unnest(ps[2:]) as after, unnest(range(1, len(ms) + 1)) as i from (
  select r, regexp_extract_all(text, '{pattern}', 0{flags}) as ms, string_split_regex(text, '{pattern}'{flags}) as ps from {table}) where len(ms) > 0))"""


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_QUOTED = _ASSIGN.replace("'", "''")

SECRETS = rf"""
with t as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text, source, lang from documents),
assign as ({_places("t", "assign", 0, _ASSIGN, "i")}),
access as ({_places("t", "access", 1, "AKIA[A-Z0-9]+")}),
hex as ({_places("t", "hex", 2, "[0-9a-f]+")}),
loose as ({_places("t", "owned", 3, "[A-Za-z0-9+/_=-]+")}),
base as materialized (
  select r, kind, o, s, e, regexp_extract(v, '{_QUOTED}', 2, 'i') as v from assign where length(regexp_extract(v, '{_QUOTED}', 2, 'i')) >= 12
  union all select r, kind, o, s, e, v from access where length(v) >= 18
  union all select r, kind, o, s, e, v from hex where length(v) >= 16),
long as materialized (select r, kind, o, s, e, v from loose
  where length(v) >= 20 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and list_entropy(string_split(v, '')) >= 3.5 - 1e-9),
free as (select * from long l where not exists (select 1 from base b where b.r = l.r and b.s < l.e and l.s < b.e)),
every as materialized (select * from base union all select * from free),
owners as (select v, count(distinct coalesce(source, chr(1))) as owners from every join t using (r) group by 1),
kept as (select every.*, owners <= 2 as live from every join owners using (v) where kind <> 'owned' or owners <= 2),
listed as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  count(*) filter (live) as n_live, string_agg(kind || ':' || s || ':' || e, ',' order by s, o) as spans,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (kind <> 'owned') as base from kept group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from t left join listed using (r)
"""

PERSONAL = rf"""
with t as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
email as ({_places("t", "email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")}),
ip as ({_places("t", "ip", 1, "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)")}),
card as ({_places("t", "card", 2, "[0-9](?:[\\x20-]?[0-9])+")}),
phone as ({_places("t", "phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]")}),
iban as ({_places("t", "iban", 4, "[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}")}),
digits as (select *, regexp_replace(v, '[^0-9]', '', 'g') as d from card union all select *, regexp_replace(v, '[^0-9]', '', 'g') as d from phone),
numbers as (select *, list_sum(list_transform(range(1, length(d) + 1), lambda i:
  case when i % 2 = 1 then cast(substr(d, length(d) + 1 - i, 1) as int) else cast(substr('0246813579', cast(substr(d, length(d) + 1 - i, 1) as int) + 1, 1) as int) end)) as luhn from digits where length(d) between 9 and 19),
account as (select *, replace(v, ' ', '') as a from iban where not regexp_matches(before, '[A-Za-z0-9]$') and not regexp_matches(after, '^[A-Za-z0-9]')),
-- letters count from 10; hugeints hold the remainder of two parts one after another
spelt as (select *, array_to_string(list_transform(string_split(substr(a, 5) || substr(a, 1, 4), ''), lambda c: case when ascii(c) > 57 then cast(ascii(c) - 55 as varchar) else c end), '') as q from account where length(a) between 15 and 34),
rest as (select *, cast(cast(substr(q, 1, 30) as hugeint) % 97 as varchar) || substr(q, 31) as q2 from spelt),
rest2 as (select *, cast(cast(substr(q2, 1, 30) as hugeint) % 97 as varchar) || substr(q2, 31) as q3 from rest),
found as (select r, kind, o, s, e from email
  union all select r, kind, o, s, e from ip where list_max(list_transform(string_split(v, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 else cast('0' || ltrim(x, '0') as int) end)) <= 255
  union all select r, kind, o, s, e from numbers where kind = 'card' and length(d) between 13 and 19 and luhn % 10 = 0
  union all select r, kind, o, s, e from numbers where kind = 'phone' and length(d) between 9 and 15
  union all select r, kind, o, s, e from rest2 where cast(q3 as hugeint) % 97 = 1),
listed as (select r, count(*) filter (o = 0) as n_email, count(*) filter (o = 1) as n_ip, count(*) filter (o = 2) as n_card, count(*) filter (o = 3) as n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < 4) as base from found group by 1)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join listed using (r)
"""

ORACLE: dict[str, str] = {"op1_exact_dedup": EXACT, "op5_decontamination": CONTAMINATION, "op7_secrets": SECRETS, "op8_pii": PERSONAL, "op9_substring": REPEATS}
