"""Reference tokens in documents."""

from __future__ import annotations

from ..operators.references import FIELDS, reference_tokens
from ..tables import table
from .registry import query

FIELD = r"^[ \t]*([A-Za-z][A-Za-z0-9_-]*)[ \t]*:[ \t]*"
_names = ", ".join(f"'{f}'" for f in sorted(FIELDS))


@query(rf"""
with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as n from (select doc_id, string_split(text, chr(10)) as x from documents)),
s as (select doc_id, n, case when ends_with(line, chr(13)) then left(line, -1) else line end as line from l),
c as (select doc_id, n, line, list_transform(string_split(line, ''), lambda c: {{'q': '', 'p': '', 'o': '', 'c': c}}) as cs from s where contains(line, '@')),
m as (select doc_id, n, line, list_reduce([{{'q': '', 'p': '', 'o': '', 'c': ''}}] || cs, lambda a, x: case
    when x.c in ('"', '''') and a.p <> '\' then {{'q': case when a.q = '' then x.c when a.q = x.c then '' else a.q end, 'p': x.c, 'o': a.o || ' ', 'c': ''}}
    else {{'q': a.q, 'p': x.c, 'o': a.o || case when a.q <> '' then ' ' else x.c end, 'c': ''}} end).o as masked from c),
a as (select doc_id, n, unnest(range(1, length(masked) + 1)) as i, masked from m),
t as (select doc_id, n, i, regexp_extract(substring(masked, i), '^@[A-Za-z0-9_.#-]*') as raw, '@' as field from a where masked[i] = '@'),
f as (select doc_id, n, line, regexp_extract(line, '{FIELD}', 1) as field, regexp_extract(line, '{FIELD}') as head from s where regexp_matches(line, '{FIELD}')),
v as (select *, regexp_split_to_array(substring(line, length(head) + 1), '[|,\[\]]') as parts from f where field in ({_names})),
w as (select doc_id, n, field, unnest(parts) as part, unnest(list_transform(range(1, len(parts) + 1), lambda k: length(head) + k + coalesce(list_sum(list_transform(parts[1:k - 1], lambda y: length(y))), 0))) as i from v),
b as (select doc_id, n, i, raw, field from t union all select doc_id, n, i::bigint + length(part) - length(ltrim(part)), trim(part), field from w),
z as (select *, rtrim(case when starts_with(raw, '@') then substring(raw, 2) else raw end, ';') as target from b)
select doc_id, n::int as line, i::int as "column", (i + length(raw))::int as end_column, min(field) filter (where true) as field, raw, target,
  case when contains(target, '#') then string_split(target, '#')[1] end as alias, string_split(target, '#')[-1] as local_id
from z where regexp_full_match(target, '[A-Za-z0-9_.-]+(?:#[A-Za-z0-9_.-]+)?') group by all""")
def reference_ranges(spark, sf_dir):
    """Every document's reference fields and @ tokens outside quotes, with their places."""
    return reference_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
