"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
             when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select doc_id, len(s)::bigint as n from s), u as (select doc_id, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a as x, b as y from l union all select b, a from l),
r as (select doc_id as v, doc_id as m from n union select e.y, r.m from r join e on e.x = r.v where r.m < e.y)
select n.doc_id, n.n as n_shingles, min(r.m) as component_id from n join r on r.v = n.doc_id group by 1, 2
"""

OP8 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  case when coalesce(length(text), 0) = 0 then 1.0 else greatest(len(regexp_extract_all(text, '[\p{L} ]')) / length(text), 0.05::double) end as share,
  (('0x' || substr(md5('7|' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from documents),
k as (select doc_id, source, size, -ln(u) / (share * share) as key from d),
s as (select source, sum(size)::bigint as source_size from k group by 1),
o as (select source, source_size, 2.0::double * source_size as cap, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w from s),
q as (select *, 1.5::double * sum(source_size) over () as budget, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as w_rest from o),
l as (select *, (budget - cap_before) / w_rest as level from q),
f as (select arg_min(level, cap / w) as level from l where level * w <= cap),
t as (select source, source_size, least(cap, coalesce((select level from f) * w, cap)) as target from l),
e as (select source, source_size, target, case when source_size > 0 then floor(target / source_size)::integer else 0 end as epochs from t),
c as (select k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest, sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and current row) - k.size / 2.0::double as middle
  from k join e on k.source is not distinct from e.source),
z as (select *, epochs + case when middle <= rest and (middle - size / 2.0::double < rest or size = 0) then 1 else 0 end as copies from c)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, source from z
"""

OP9 = rf"""
with w as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents where text is not null and doc_id is not null),
n as (select count(*)::double as n, avg(len(w)) as mean from w), l as (select doc_id, len(w) as len from w),
tf as (select doc_id, t, count(*)::double as tf from (select doc_id, unnest(w) as t from w) group by 1, 2),
df as (select t, count(*)::double as df from tf group by 1),
q as (select doc_id as query_id, t, tf * ln(1 + ((select n from n) - df + 0.5) / (df + 0.5)) as w from tf join df using (t) where doc_id % 50 = 0),
s as (select query_id, doc_id, round(sum(q.w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (select mean from n)))), 6) as score from q join tf using (t) join l using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, rank::integer as rank, doc_id, score from r where rank <= 10
"""


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    return f"select doc_id, {kind} as rank, {least} as least, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {group}) as g, string_split_regex(t, '{pattern}') as s from d"


#: Runs of base64 characters, and runs of letters and digits: the entropy candidates.
RUNS = {3: r"[A-Za-z0-9+/_=-]{24,}", 4: r"[0-9A-Za-z]{16,}"}
ALLOWED = " or ".join(f"regexp_matches(piece, '{p}')" for p in (r"(?i)example", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)0123456789abcdef|fedcba9876543210|abcdefghijklmnop", r"(?i)deadbeefdeadbeef"))


def _entropy(name: str, width: int, bits: float, fold: str) -> str:
    """Windows of a run whose sum of c * log2(c) is small enough, as the span from the first to the last."""
    c_log_c = "list_sum(list_transform(map_values(list_histogram(x[i:i + {w} - 1])), lambda c: c * log2(c)))".format(w=width)
    return f"""{name}w as (select doc_id, start, len(x) as n, x, unnest(range(1, len(x) - {width} + 2)) as i from (select doc_id, start, string_split({fold}, '') as x from {name})),
      {name}e as (select doc_id, start + min(i) - 1 as start, start + max(i) + {width} - 1 as stop from (select doc_id, start, i, {c_log_c} as t from {name}w) where t <= {width} * (log2({width}) - {bits}) + 1e-9 group by doc_id, start)"""


OP1 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
b as ({_spans(0, """(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8)} union all {_spans(1, 'AKIA[A-Z0-9]+', 0, 16)} union all {_spans(2, '[0-9a-f]+', 0, 32)}
  union all {_spans(3, RUNS[3], 0, 24)} union all {_spans(4, RUNS[4], 0, 16)}),
p as (select doc_id, rank, least, m, g, s, unnest(range(1, len(m) + 1)) as i from b),
q as (select doc_id, rank, m[i] as piece, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as start from p where length(g[i]) >= least),
a as (select doc_id, rank, start::integer as start, (start + length(piece))::integer as stop, piece from q),
base as (select doc_id, rank, start, stop from a where rank < 3),
h as (select * from a where rank = 4 and regexp_full_match(piece, '[0-9A-Fa-f]+') and regexp_matches(piece, '[0-9]') and regexp_matches(piece, '[A-Fa-f]') and not ({ALLOWED})),
r as (select * from a where rank = 3 and regexp_matches(piece, '[0-9]') and regexp_matches(piece, '[A-Z]') and regexp_matches(piece, '[a-z]') and not ({ALLOWED})),
{_entropy('h', 16, 2.75, 'lower(piece)')}, {_entropy('r', 24, 3.9, 'piece')},
e as (select doc_id, 3 as rank, start, stop from he union select doc_id, 3, start, stop from re where not exists (select 1 from he where he.doc_id = re.doc_id and he.start <= re.start and re.stop <= he.stop)),
x as (select * from base union all select * from e where not exists (select 1 from base where base.doc_id = e.doc_id and base.start <= e.start and e.stop <= base.stop)),
n as (select doc_id, rank, start, stop, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || start || ':' || stop as said from x)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, sha256(coalesce(string_agg(said, ',' order by start, rank, stop) filter (rank < 3), '')) as base_sha256,
  coalesce(string_agg(said, ',' order by start, rank, stop), '') as spans, count(*) filter (rank = 3) as n_entropy from d left join n on n.doc_id = d.doc_id group by d.doc_id
"""


def _discounted(k: int) -> str:
    """CTEs of order k: n{k} with cut, x{k} (contexts), p{k} (probabilities by interpolation)."""
    cut = "case when c = 1 then d1 when c = 2 then d2 else d3 end"
    made = f"""f{k} as (select count(*) filter (c = 1)::double as n1, count(*) filter (c = 2)::double as n2, count(*) filter (c = 3)::double as n3, count(*) filter (c = 4)::double as n4 from c{k}),
      y{k} as (select *, n1 / (n1 + 2 * n2) as y from f{k}), e{k} as (select case when n1 = 0 or n2 = 0 then 0.5 else least(greatest(1 - 2 * y * n2 / n1, 0.05), 0.95) end as d1, case when n1 = 0 or n2 = 0 then 0.75 else least(greatest(2 - 3 * y * n3 / n2, 0.05), 1.9) end as d2,
        case when n1 = 0 or n2 = 0 then 0.9 when n3 > 0 then least(greatest(3 - 4 * y * n4 / n3, 0.05), 2.9) else least(greatest(2 - 3 * y * n3 / n2, 0.05), 2.9) end as d3 from y{k}),
      n{k} as (select g, c::double as c, left(g, {2 * k - 2}) as x, substr(g, 3) as s, {cut} as cut from c{k}, e{k})"""
    if k == 1:
        return made + ", z1 as (select sum(c) as total, sum(cut) as spared from n1), p1 as (select v as g, greatest(coalesce(c - cut, 0), 0) / total + spared / total / 256 as p from (select lpad(to_hex(unnest(range(256))), 2, '0') as v) left join n1 on n1.g = v, z1)"
    return made + f", x{k} as (select x, sum(c) as total, sum(cut) / sum(c) as leave from n{k} group by 1), p{k} as (select n.g, (c - cut) / total + leave * l.p as p from n{k} n join x{k} using (x) join p{k - 1} l on l.g = n.s)"


def _backed_off(k: int) -> str:
    """What is open at order k: found in p{k}, or it leaves the context."""
    rest = "0.0::double" if k == 5 else f"o{k + 1}.bits"
    source = "m" if k == 5 else f"o{k + 1}"
    where = "" if k == 5 else f" where not o{k + 1}.done"
    if k == 1:
        return "o1 as (select o2.g, o2.bits - log2(p1.p) as bits from o2 join p1 on p1.g = right(o2.g, 2) where not o2.done)"
    return f"o{k} as (select {source}.g, {rest} + case when p.p is not null then -log2(p.p) else coalesce(-log2(x.leave), 0) end as bits, p.p is not null as done from {source} left join p{k} p on p.g = right({source}.g, {2 * k}) left join x{k} x on x.x = left(right({source}.g, {2 * k}), {2 * k - 2}){where})"


#: Whether crc32 of the id's digits is divisible by 5: eight steps for each byte.
HELD = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, case when xor(c, x) & 1 = 1 then 3988292384 else 0 end)), 4294967295) % 5 = 0"""

OP6 = f"""
with t as (select doc_id from (select doc_id, min(quality) as q from labels group by 1) where q = 1 and doc_id is not null),
d as (select row_number() over () as i, doc_id, lang, text from documents), h as (select i, doc_id, string_split(hex(encode(text)), '') as x from d where text <> ''),
b as (select i, doc_id, list_concat(['00', '00', '00', '00'], list_transform(range(1, len(x) // 2 + 1), lambda j: x[2 * j - 1] || x[2 * j])) as b from h),
r as (select i, doc_id, unnest(list_transform(range(1, len(b) - 3), lambda j: b[j] || b[j + 1] || b[j + 2] || b[j + 3] || b[j + 4])) as g from b),
u as (select distinct doc_id, {HELD} as held from t),
c5 as (select g, count(*) as c from r where doc_id in (select doc_id from u where not held) group by 1), {', '.join(f'c{k} as (select substr(g, 3) as g, count(*) as c from c{k + 1} group by 1)' for k in (4, 3, 2, 1))},
{', '.join(_discounted(k) for k in range(1, 6))}, m as (select distinct g from r), {', '.join(_backed_off(k) for k in (5, 4, 3, 2, 1))},
w as ({' union all '.join(f'select g, bits from o{k} where done' for k in (5, 4, 3, 2))} union all select g, bits from o1),
s as (select r.i, sum(bits) / count(*) as bits from r join w using (g) group by 1),
a as (select d.i, d.doc_id, d.lang, 2 ** bits as perplexity from d left join s on s.i = d.i),
k as (select coalesce(lang, chr(1)) as lang, perplexity as p from a where perplexity is not null and doc_id in (select doc_id from u where held)),
o as (select lang, p, row_number() over (partition by lang order by p) as i, count(*) over (partition by lang) as n, row_number() over (order by p) as j, count(*) over () as m from k),
l as (select lang, least(min(p) filter (i >= ceil(0.995 * n)), min(p) filter (i >= ceil(0.75 * n)) + 3 * (min(p) filter (i >= ceil(0.75 * n)) - min(p) filter (i >= ceil(0.25 * n)))) as own from o group by 1),
f as (select least(min(p) filter (j >= ceil(0.995 * m)), min(p) filter (j >= ceil(0.75 * m)) + 3 * (min(p) filter (j >= ceil(0.75 * m)) - min(p) filter (j >= ceil(0.25 * m)))) as overall from o)
select doc_id, a.lang, round(perplexity, 6) as perplexity, round(coalesce(own, overall), 6) as limit, perplexity is not null and coalesce(perplexity <= coalesce(own, overall), true) as keep from a cross join f left join l on l.lang = coalesce(a.lang, chr(1))
"""


OP11 = rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
u as (select i, lang, source, unnest(w) as t from d), k as (select lang, t from u group by 1, 2 having count(distinct i) >= 30),
c as (select lang, source, t, count(*) as c from u join k using (lang, t) group by 1, 2, 3), v as (select lang, count(*) as v from k group by 1),
g as (select distinct lang, source from d), n as (select g.lang, g.source, coalesce(sum(c), 0)::bigint as n from g left join c on c.lang = g.lang and c.source = g.source group by 1, 2),
m as (select lang, sum(n)::bigint as n from n group by 1), l as (select lang, t, sum(c)::bigint as c from c group by 1, 2),
p as (select n.lang, n.source, k.t, coalesce(c.c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v) as p from n join v on v.lang = n.lang join k on k.lang = n.lang left join c on c.lang = n.lang and c.source = n.source and c.t = k.t),
q as (select lang, t, 1 + 1000000000::hugeint * (l.c + 5) // (m.n + 5 * v.v) as q from l join m using (lang) join v using (lang)),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.t = x.t group by 1, 2, 4),
terms as (select p.lang, source, 'term' as part, t as item, (p - q)::bigint as value from p join q using (lang, t) where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pairs union all select * from terms))
select * from r where part = 'pair' or rank <= 50
"""

#: Unsigned CRC-32 of the bytes of a text, a bit at a time.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(hex(encode(t))) // 2 + 1), lambda i: [('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, case when xor(c, x) & 1 = 1 then 3988292384 else 0 end)), 4294967295)"""


def _features(name: str, table: str, id_: str) -> str:
    """Words of a table's texts as rows."""
    return f"{name} as (select {id_} as id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as t from {table})"


OP13 = f"""
with {_features('a', 'documents', 'doc_id')}, {_features('e', 'benchmark', 'item_id')},
h as (select t, {CRC} % 10000 as b from (select distinct t from (select t from a union all select t from e))),
x as (select id, b from a join h using (t)), s as (select b, count(*) as n from x group by 1), y as (select b, count(*) as n from e join h using (t) group by 1),
g as (select b, floor(1000 * ln((coalesce(y.n, 0) + 1.0::double) * ((select count(*) from a) + 10000.0::double) / ((coalesce(s.n, 0) + 1.0::double) * ((select count(*) from e) + 10000.0::double))))::bigint as gain
  from (select unnest(range(10000)) as b) left join s using (b) left join y using (b)),
w as (select id as doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from x join g using (b) group by 1),
o as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from documents left join w using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from o where n_features >= 20)
select o.doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from o left join r using (doc_id)
"""
