"""The queries that SQL can say in full, for an independent engine over the same tables."""

from __future__ import annotations

from reachlake.llm.lm import ADD, DISCOUNT, FOLDS
from reachlake.llm.prefix_trie import STEM, TURNS
from reachlake.llm.quality import DELTA, GRID, RISK, RULES, SYMBOLS
from reachlake.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SCALE
from reachlake.llm.resampling import SEED as SEED11
from reachlake.llm.secrets import BOUNDS, WINDOW
from reachlake.llm.simhash import RADIUS, SEED, SHINGLE

SPACE = r"[\x20\x09-\x0D]+"
QUOTE = r"""[\"'']?"""
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key){QUOTE}\x20*[:=]\x20*{QUOTE})([A-Za-z0-9+/_.=-]+)"


def places(kind: str, place: int, pattern: str) -> str:
    """Matches of a kind with their places in code points: gaps and matches take turns."""
    return f"""select doc_id, '{kind}' as kind, {place} as place, m, k, upto - length(m) as s, upto as e from (
        select doc_id, m, k, sum(length(gap) + length(m)) over (partition by doc_id order by k)::bigint as upto
        from (select doc_id, unnest(hits) as m, unnest(gaps[:len(hits)]) as gap, generate_subscripts(hits, 1) as k
              from (select doc_id, regexp_extract_all(body, '{pattern}') as hits, string_split_regex(body, '{pattern}') as gaps from docs)))"""


ALLOWED = "|".join([
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", "(?i:abcdefghij|0123456789|1234567890|qwertyuiop)", "^[A-Za-z]*(?:[/_=-](?:[A-Za-z]*|[0-9]{1,4}))+$", "(?i:example|placeholder|changeme|dummy)",
])

SECRETS = rf"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
base as (
  select doc_id, kind, place, s, e from ({places("assign", 0, ASSIGN)}) where length(regexp_extract(m, '{ASSIGN}', 2)) >= 12
  union all select doc_id, kind, place, s, e from ({places("access", 1, "AKIA[A-Z0-9]+")}) where length(m) >= 18
  union all select doc_id, kind, place, s, e from ({places("hex", 2, "[0-9a-f]+")}) where length(m) >= 16),
candidates as (
  select c.* from ({places("entropy", 3, "[A-Za-z0-9+/_=-]{20,}")}) c
  where regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and not regexp_matches(m, '{ALLOWED}') and not exists (select 1 from base b where b.doc_id = c.doc_id and b.s < c.e and c.s < b.e)),
entropy as (
  select doc_id, kind, place, s, e from candidates
  where list_max(list_transform(range(1, length(m) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy')))
        >= case when regexp_matches(m, '^[0-9A-Fa-f]+$') then {BOUNDS["hex"]} when regexp_matches(m, '^[A-Za-z0-9]+$') then {BOUNDS["alphanumeric"]} else {BOUNDS["base64"]} end),
every as (select * from base union all select * from entropy),
listed as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (where kind <> 'entropy') as b, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans
  from every group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join listed using (doc_id)"""

#: The exact binomial bound as in quality.allowed: the sum of the terms up to k, of which the largest k within the level is taken.
LEVEL = f"{DELTA} / (strata * {len(RULES)})"
RATE = RISK / len(RULES)
QUALITY = rf"""
with docs as (select doc_id, coalesce(text, '') as body, coalesce(lang, '') as stratum from documents),
split as (select *, list_filter(string_split_regex(body, '{SPACE}'), lambda x: x <> '') as w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
wins as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as v from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from split)),
twice as (select doc_id, i from wins qualify count(*) over (partition by doc_id, v) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
base as (
  select s.doc_id, stratum, len(w) as n_words, length(regexp_replace(body, '{SPACE}', '', 'g')) as word_chars, length(body) - length(translate(body, '{SYMBOLS}', '')) as n_symbols, len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from split s left join covered c using (doc_id)),
feats as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from base),
vals as (
  select doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols', 'value': least(1.0, coalesce(n_symbols::double / nullif(word_chars, 0), 0.0))}}, {{'rule': 'dup_lines', 'value': least(1.0, coalesce(n_dup_lines::double / nullif(n_lines, 0), 0.0))}},
    {{'rule': 'repeats', 'value': least(1.0, coalesce(n_repeat_words::double / nullif(n_words, 0), 0.0))}}, {{'rule': 'long_words', 'value': greatest(0.0, least(1.0, (coalesce(word_chars::double / nullif(n_words, 0), 0.0) - 5) / 20))}}]) as x from feats),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
held as (select stratum, x.rule as rule, x.value as value from vals where not base_failed and doc_id in (select doc_id from good)),
totals as (select stratum, rule, count(*) as n, (select count(distinct stratum) from held) as strata from held group by stratum, rule),
terms as (
  select stratum, rule, n, strata, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RATE}) + (n - k) * ln(1 - {RATE})) as p
  from (select *, unnest(range(0, ceil(n * {RATE})::bigint + 1)) as k from totals)),
most as (select stratum, rule, coalesce(max(k) filter (where total <= level), -1) as most from (select *, {LEVEL} as level, sum(p) over (partition by stratum, rule order by k) as total from terms) group by stratum, rule),
grid as (select unnest({GRID}) as cutoff),
rejected as (select h.stratum, h.rule, g.cutoff, count(*) filter (where h.value > g.cutoff) as n from held h cross join grid g group by all),
cutoffs as (select stratum, rule, min(cutoff) as cutoff from rejected join most using (stratum, rule) where n <= most group by stratum, rule),
broken as (
  select doc_id, string_agg(x.rule, ',' order by list_position({list(RULES)}, x.rule)) as rejected_by from vals v join cutoffs c on c.stratum = v.stratum and c.rule = v.x.rule and v.x.value > c.cutoff group by doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and b.rejected_by is null as kept, coalesce(b.rejected_by, '') as rejected_by
from feats f left join broken b using (doc_id)"""

EXACT = rf"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
from d window w as (partition by body)"""

#: Every 100-byte string of every text, in hexadecimal, with its place; of equal ones all but the first are repeats.
REPEATS = """
with d as (select doc_id, encode(coalesce(text, '')) as body from documents),
hexed as (select doc_id, hex(body) as h, octet_length(body)::bigint as n from d),
strings as (select doc_id, p, substr(h, 2 * p + 1, 200) as v from (select doc_id, h, unnest(range(0, n - 99)) as p from hexed)),
repeats as (select doc_id, p from (select doc_id, p, row_number() over (partition by v order by doc_id, p) as nth from strings) where nth > 1),
opened as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as opens from repeats),
numbered as (select *, sum(opens) over (partition by doc_id order by p) as run from opened),
runs as (select doc_id, min(p) as s, max(p) + 100 as e from numbered group by doc_id, run),
gaps as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from runs),
cut as (select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans, max(e) as last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s) as front from gaps join hexed using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from hexed left join cut using (doc_id)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def arc(count: str, seen: str, excess: str, shorter: str) -> str:
    """A discounted probability with its backoff; without the history in training, the shorter one."""
    return f"""case when coalesce({seen}, 0) = 0 then {shorter} else greatest(coalesce({count}, 0) - {DISCOUNT}, 0.0)::double / {seen}
      + greatest(1e-9, {DISCOUNT}::double * ({seen} - coalesce({excess}, 0)) / {seen}) * ({shorter}) end"""


#: crc32 byte by byte over a table of 256 remainders; then counts of n-grams and the backoff model in joins.
SCORES = rf"""
with table256 as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) order by i) as t from range(256) r(i)),
docs as (
  select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)),
         lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8)), 4294967295) % {FOLDS} = 0 as held_out, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents, table256),
split as (select doc_id, held_out, list_append(list_filter(string_split_regex(body, '{SPACE}'), lambda x: x <> ''), ' ') as w from docs),
tokens as (select doc_id, held_out, i, w[i] as w3, case when i > 1 then w[i - 1] end as w2, case when i > 2 then w[i - 2] end as w1 from (select *, unnest(range(1, len(w) + 1)) as i from split)),
trained as (select * from tokens where not held_out),
one as (select w3, count(*) as c from trained group by w3),
two as (select w2, w3, count(*) as c from trained where w2 is not null group by w2, w3),
three as (select w1, w2, w3, count(*) as c from trained where w1 is not null group by w1, w2, w3),
after_one as (select w2, sum(c - 1)::bigint as x from two group by w2),
after_two as (select w1, w2, sum(c - 1)::bigint as x from three group by w1, w2),
totals as (select coalesce(sum(c), 0)::bigint as n, coalesce(sum(c), 0) + {ADD}::double * (count(*) + 1) as scale from one),
met as (
  select t.*, o.c as c3, h.c as c2, b.c as c23, g.c as c12, d.c as c123, a1.x as x2, a2.x as x12, (coalesce(o.c, 0) + {ADD}::double) / scale as p1, n
  from tokens t cross join totals left join one o on o.w3 = t.w3 left join one h on h.w3 = t.w2 left join two b on b.w2 = t.w2 and b.w3 = t.w3 left join two g on g.w2 = t.w1 and g.w3 = t.w2
  left join three d on d.w1 = t.w1 and d.w2 = t.w2 and d.w3 = t.w3 left join after_one a1 on a1.w2 = t.w2 left join after_two a2 on a2.w1 = t.w1 and a2.w2 = t.w2),
paired as (select *, {arc("c23", "c2", "x2", "p1")} as p2 from met),
scored as (select *, {arc("c123", "c12", "x12", "p2")} as p3 from paired)
select doc_id, held_out, count(*) as n_tokens, count(c3) as n_known, any_value(n) as train_tokens, round(fsum(log10(p1)), 7) as base_score, round(fsum(log10(p3)), 7) as score from scored group by doc_id, held_out"""

#: crc32 of the bytes of each distinct run of words, counts by bucket, and the draw.
RESAMPLED = rf"""
with table256 as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) order by i) as t from range(256) r(i)),
texts as (select 's' as side, row_number() over () as r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents union all select 't', row_number() over (), null, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') from benchmark),
split as (select *, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
runs as (select side, r, unnest(w) as v from split union all select side, r, w[i] || ' ' || w[i + 1] from (select side, r, w, unnest(range(1, len(w))) as i from split)),
counted as materialized (select side, r, v, count(*) as c from runs group by all),
coded as (select v, hex(encode(v)) as h, octet_length(encode(v)) as n from (select distinct v from counted)),
hashed as materialized (
  select v, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * j + 1, 2))::bigint for j in range(n)]), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % {BUCKETS} as bucket from coded, table256),
buckets as (select bucket, coalesce(sum(c) filter (where side = 's'), 0) as s, coalesce(sum(c) filter (where side = 't'), 0) as t from counted join hashed using (v) group by bucket),
totals as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from buckets),
gains as (select bucket, floor({SCALE} * ln((t + 1)::double * (s_all + {BUCKETS}) / ((s + 1)::double * (t_all + {BUCKETS}))))::bigint as gain from buckets, totals),
sums as (select r, sum(c)::bigint as n, sum(c * gain)::hugeint as total from counted join hashed using (v) join gains using (bucket) where side = 's' group by r),
weighed as (
  select doc_id, split.r, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(floor(total::double / n), 0)::bigint as weight, ('0x' || substr(sha256('{SEED11}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from split left join sums using (r) where side = 's'),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from weighed),
ranked as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id, r) as place, (select {PERCENT} * count(*) // 100 from scored where n_words >= {LEAST_WORDS}) as drawn from scored)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and place <= drawn then place end as rank from ranked"""

#: The trie by its definition: every node's subtree is the nodes whose sequences start with its own.
TRIE = rf"""
with table256 as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) order by i) as t from range(256) r(i)),
turns as (
  select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as name, octet_length(encode(coalesce(text, ''))) as bytes,
         row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - ((conv_id % {STEM} + {STEM}) % {STEM}) as stem,
         xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(conv_id::varchar, ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)), lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8)), 4294967295) % {TURNS} as shared
  from (select distinct conv_id from turns), table256),
members as (
  select c.conv_id, false as own, t.place, t.name, t.bytes from convs c join turns t on t.conv_id = c.stem and t.place <= c.shared
  union all select c.conv_id, true, t.place, t.name, t.bytes from convs c join turns t on t.conv_id = c.conv_id and t.place > c.shared),
placed as (select conv_id, name, bytes, row_number() over (partition by conv_id order by own, place) as depth from members),
lists as (select c.conv_id, coalesce(list(name order by depth) filter (where name is not null), []) as names, coalesce(list(bytes order by depth) filter (where name is not null), []) as sizes from convs c left join placed p using (conv_id) group by c.conv_id),
paths as (select conv_id, names, sizes, unnest(range(0, len(names) + 1)) as depth from lists),
keyed as (select conv_id, depth, array_to_string(names[:depth], '') as name, array_to_string(names[:depth - 1], '') as up, case when depth > 0 then sizes[depth] else 0 end as bytes, depth = len(names) as ends from paths),
nodes as materialized (
  select depth, name, any_value(up) as up, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from keyed group by depth, name),
children as (select up, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
wide as (select n.*, p.conv_id as parent_conv_id, coalesce(c.n, 0) as n_children from nodes n left join nodes p on p.depth = n.depth - 1 and p.name = n.up left join children c on c.depth = n.depth and c.up = n.name)
select u.conv_id, u.depth, any_value(u.parent_conv_id) as parent_conv_id, any_value(u.n_convs) as n_convs, any_value(u.n_children) as n_children, count(*) filter (where v.n_children = 0) as n_leaves, sum((v.n_convs - 1) * v.bytes)::bigint as saved_tokens,
       any_value(u.ends_sha256) as ends_sha256
from wide u join wide v on v.depth >= u.depth and substr(v.name, 1, 64 * u.depth) = u.name group by u.conv_id, u.depth"""

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
WORD = 1 << 64


def times(a: str, b: int) -> str:
    """A product modulo 2^64, of 128-bit unsigned numbers."""
    return f"((({a}) * {b}::uhugeint) % {WORD}::uhugeint)"


def turned(a: str, bits: int) -> str:
    return f"((({a}) * {1 << bits}::uhugeint) % {WORD}::uhugeint + ({a}) // {1 << 64 - bits}::uhugeint)"


def plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {WORD}::uhugeint)"


def mixed_in(a: str, lane: str) -> str:
    return times(turned(plus(a, times(lane, P2)), 31), P1)


def little(h: str, at: str, size: int) -> str:
    """The number that size bytes of a hexadecimal text spell, the lowest first."""
    return "('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::ubigint::uhugeint"


def merged(h: str, a: str) -> str:
    return plus(times(f"xor({h}, {mixed_in('0::uhugeint', a)})", P1), f"{P4}::uhugeint")


STARTS = [(SEED + P1 + P2) % WORD, (SEED + P2) % WORD, SEED, (SEED - P1) % WORD]
STRIPES = ", ".join(f"list_reduce(list_prepend({start}::uhugeint, [lanes[4 * j + {k + 1}] for j in range(n // 32)]), lambda a, x: {mixed_in('a', 'x')}) as v{k}" for k, start in enumerate(STARTS))

#: XXH64 of each distinct shingle in steps of its definition, the majority of each bit, and the closure of the links.
NEAR = rf"""
with recursive docs as (select doc_id, row_number() over () as r, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') as w from documents),
shingles as (select r, case when len(w) < {SHINGLE} then array_to_string(w, ' ') else array_to_string(w[i : i + {SHINGLE - 1}], ' ') end as v from (select r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as i from docs where len(w) > 0)),
texts as materialized (select v, hex(encode(v)) as h, octet_length(encode(v))::bigint as n from (select distinct v from shingles)),
laned as (select *, [{little("h", "8 * j", 8)} for j in range(n // 8)] as lanes from texts),
striped as (select *, {STRIPES} from laned),
summed as (select *, {plus(plus(turned("v0", 1), turned("v1", 7)), plus(turned("v2", 12), turned("v3", 18)))} as s from striped),
merged0 as (select *, {merged("s", "v0")} as m from summed), merged1 as (select * exclude (m), {merged("m", "v1")} as m from merged0),
merged2 as (select * exclude (m), {merged("m", "v2")} as m from merged1), merged3 as (select * exclude (m), {merged("m", "v3")} as m from merged2),
begun as (select v, h, n, lanes, {plus("case when n >= 32 then m else " + str((SEED + P5) % WORD) + "::uhugeint end", "n::uhugeint")} as m from merged3),
eights as (select v, h, n, list_reduce(list_prepend(m, lanes[4 * (n // 32) + 1 :]), lambda a, x: {plus(times(turned(f"xor(a, {mixed_in('0::uhugeint', 'x')})", 27), P1), f"{P4}::uhugeint")}) as m from begun),
fours as (select v, h, n, case when n % 8 >= 4 then {plus(times(turned(f"xor(m, {times(little('h', '8 * (n // 8)', 4), P1)})", 23), P2), f"{P3}::uhugeint")} else m end as m from eights),
singles as (select v, list_reduce(list_prepend(m, [{little("h", "4 * (n // 4) + j", 1)} for j in range(n % 4)]), lambda a, x: {times(turned(f"xor(a, {times('x', P5)})", 11), P1)}) as m from fours),
first_mix as (select v, {times(f"xor(m, m // {1 << 33}::uhugeint)", P2)} as m from singles), second_mix as (select v, {times(f"xor(m, m // {1 << 29}::uhugeint)", P3)} as m from first_mix),
hashes as materialized (select v, xor(m, m // {1 << 32}::uhugeint)::ubigint as m from second_mix),
bits as (select r, b, sum((m >> b) & 1) as ones, count(*) as n from shingles join hashes using (v) cross join range(64) bit(b) group by r, b),
prints as (select r, sum(case when 2 * ones > n then (2::hugeint ** b)::hugeint else 0 end)::ubigint as fp from (select r, b::hugeint as b, ones, n from bits) group by r),
rows as materialized (select doc_id, coalesce(fp, 0)::ubigint as fp from docs left join prints using (r)),
fps as materialized (select fp, min(doc_id) as first from rows group by fp),
links as materialized (select a.fp as a, b.fp as b from fps a join fps b on bit_count(xor(a.fp, b.fp)::bit) <= {RADIUS}),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
names as (select a as fp, min(first) as component_id from reach join fps on fps.fp = reach.b group by a)
select doc_id, lower(lpad(to_hex(fp), 16, '0')) as fingerprint, component_id from rows join names using (fp)"""

SQL: dict[str, str] = {"op1_exact_dedup": EXACT, "op2_quality_rules": QUALITY, "op5_secret_scans": SECRETS, "op4_simhash_dedup": NEAR, "op8_suffix_dedup": REPEATS, "op10_lm_scores": SCORES, "op11_importance_resampling": RESAMPLED, "op13_prefix_trie": TRIE}
