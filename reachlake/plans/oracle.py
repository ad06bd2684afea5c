"""The registered queries as SQL over the same tables, for an independent engine."""

from __future__ import annotations

FACTS = """
symbols as (
  select p_partkey as id, 'sym:' || p_partkey as linkage_name, p_name as name, p_brand || '::' || p_partkey as qualified_name,
         case when p_partkey % 5 in (1, 2, 3) then p_type else '' end as class_name, 'void (' || p_size || ')' as signature,
         case p_partkey % 5 when 1 then 'method' when 2 then 'constructor' when 3 then 'destructor' else 'function' end as kind,
         case when p_partkey % 10 = 9 then 'external_opaque' when p_partkey % 10 = 8 then 'indexed' else 'reportable' end as scope,
         (p_partkey % 10 <> 9 and p_partkey % 13 <> 0) as defined, (p_partkey % 7 = 3) as internal_linkage, (p_partkey % 5 = 1 and p_partkey % 3 = 0) as is_virtual,
         case when p_partkey % 17 = 0 then null else p_brand || '/' || (p_size // 10) || '.cpp' end as file,
         1 + (p_partkey * 7) % 900 as begin_line, 1 + (p_partkey * 7) % 900 + p_size as end_line
  from part),
pairs as (
  select distinct a.l_partkey as f, b.l_partkey as t, a.l_quantity as q, a.l_linenumber as ln
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_quantity >= 49 and a.l_partkey <> b.l_partkey),
edges as (
  select distinct f as src, t as dst, case ln when 1 then 'direct_call' when 2 then 'direct_call' when 3 then 'constructs' when 4 then 'virtual_dispatch' when 5 then 'callback_registration' else 'provider' end as kind
  from (select f, t, ln from pairs union select t, f, ln from pairs where q = 50)),
roots as (
  select id as symbol, case when id % 194 = 0 then 'application_entry_point' when id % 194 = 97 then 'provider' else 'public_api' end as kind
  from symbols where id % 97 = 0 or (id % 101 = 5 and scope = 'reportable')),
escapes as (select distinct l_partkey as symbol from lineitem where l_quantity = 1 and l_linenumber = 1 and l_partkey % 4 = 0),
suppressions as (select id as symbol from symbols where id % 19 = 4)"""

PROVIDED = "('callback_registration', 'provider')"


def side(prefix: str, symbols: str, edges: str, roots: str) -> str:
    """Reachability, candidates and findings of one run, as tables with a prefix."""
    p = prefix
    return f"""
{p}live(id) as (select symbol from {roots} union select e.dst from {p}live r join {edges} e on e.src = r.id join {symbols} s on s.id = r.id where s.scope in ('reportable', 'indexed')),
{p}structural(id) as (select symbol from {roots} where kind not in {PROVIDED}
  union select e.dst from {p}structural r join {edges} e on e.src = r.id join {symbols} s on s.id = r.id where s.scope in ('reportable', 'indexed') and e.kind not in {PROVIDED}),
{p}state as (
  select s.*, s.id in (select id from {p}live) as reachable, s.id in (select id from {p}structural) as structural, s.id in (select symbol from escapes) as escaped, s.id in (select symbol from suppressions) as suppressed,
         s.defined and s.scope = 'reportable' and s.kind <> 'synthetic' as own
  from {symbols} s),
{p}candidates as (
  select *, case when escaped then 'dynamically_referenced' when is_virtual then 'possibly_dead' when internal_linkage then 'dead' else 'likely_dead' end as classification
  from {p}state where own and not reachable)"""


REACH = FACTS + "," + side("", "symbols", "edges", "roots")
INDUCED = REACH + """,
induced as (select distinct src, dst from edges where src in (select id from candidates) and dst in (select id from candidates))"""
STRONG = INDUCED + """,
paths(src, dst) as (select src, dst from induced union select p.src, e.dst from paths p join induced e on e.src = p.dst),
strong as (select c.id, least(c.id, coalesce((select min(p.dst) from paths p join paths b on b.src = p.dst and b.dst = p.src where p.src = c.id), c.id)) as scc from candidates c)"""
WEAK_TABLES = """,
ties as (select src as a, dst as b from induced union select dst, src from induced),
walks(a, b) as (select a, b from ties union select w.a, t.b from walks w join ties t on t.a = w.b),
weak as (select c.*, least(c.id, coalesce((select min(b) from walks where a = c.id), c.id)) as component from candidates c)"""
WEAK = INDUCED + WEAK_TABLES
MEASURED = "(file is not null and file <> '' and begin_line > 0 and end_line >= begin_line)"


def lines(source: str, by: str) -> str:
    return f""",
ranges as (select {by}, file, begin_line, max(end_line) as end_line from ({source}) where {MEASURED} group by all),
marked as (select *, case when begin_line > max(end_line) over (partition by {by}, file order by begin_line rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as opens from ranges),
islands as (select *, sum(opens) over (partition by {by}, file order by begin_line) as island from marked),
measured as (select {by}, sum(n) as lines from (select {by}, file, island, max(end_line) - min(begin_line) + 1 as n from islands group by all) group by all),
counted as (select {by}, count(*) as members, count(*) filter (where not coalesce({MEASURED}, false)) as unmeasured from ({source}) group by all)
select {', '.join('c.' + x.strip() for x in by.split(','))}, coalesce(m.lines, 0)::bigint as lines, c.members, c.unmeasured
from counted c left join measured m using ({by})"""


def owned(label: str) -> str:
    return f"with recursive {WEAK}" + lines(f"select component, {label} as label, file, begin_line, end_line from weak where coalesce({label}, '') <> ''", "component, label")


DIFF = (
    FACTS
    + """,
old_symbols as (select * from symbols where id % 29 <> 0), old_edges as (select * from edges where (src + dst) % 7 <> 0 and src % 29 <> 0 and dst % 29 <> 0), old_roots as (select * from roots where symbol % 29 <> 0),
new_symbols as (select * from symbols where id % 31 <> 0), new_edges as (select * from edges where (src + dst) % 5 <> 0 and src % 31 <> 0 and dst % 31 <> 0), new_roots as (select * from roots where symbol % 31 <> 0),"""
    + side("old_", "old_symbols", "old_edges", "old_roots")
    + ","
    + side("new_", "new_symbols", "new_edges", "new_roots")
    + """,
both_sides as (
  select coalesce(o.id, n.id) as id, o.id as oid, n.id as nid, o.reachable as was, n.reachable as is_now, oc.classification as baseline_classification, nc.classification as current_classification,
         case when n.id is not null then coalesce(n.suppressed and nc.id is not null, false) end as current_suppressed
  from (select * from old_state where own) o full join (select * from new_state where own) n on o.id = n.id left join old_candidates oc on oc.id = o.id left join new_candidates nc on nc.id = n.id),
changed as (
  select *, case when oid is null then 'new_symbol' when nid is null then 'removed' when was and not is_now then 'newly_unreachable' when not was and is_now then 'became_reachable' end as change from both_sides),
diffs as (select * from changed where change is not null)"""
)

BATCHES = FACTS + """,
batches as (
  select s.id, l.suppkey, case when (s.id + l.suppkey) % 4 = 0 then '' else s.name end as name, case when (s.id + l.suppkey) % 3 = 0 then '' else s.qualified_name end as qualified_name, s.kind, s.internal_linkage,
         case (s.id + l.suppkey) % 3 when 0 then 'reportable' when 1 then 'indexed' else 'external_opaque' end as scope, case (s.id + l.suppkey) % 3 when 0 then 3 when 1 then 2 else 1 end as rank,
         (s.id + l.suppkey) % 2 = 0 as defined, s.is_virtual and (s.id + l.suppkey) % 5 = 0 as is_virtual, 'f' || (l.suppkey % 10) as file, 1 + l.suppkey % 7 as line
  from symbols s join (select distinct l_partkey, l_suppkey as suppkey from lineitem) l on l.l_partkey = s.id)"""

SELECTORS = FACTS + """,
selectors as (
  select p_partkey as selector, case when p_partkey % 4 = 0 then (p_partkey * 2)::varchar else '' end as sid, case when p_partkey % 4 = 1 then 'sym:' || p_partkey else '' end as slink,
         case when p_partkey % 4 >= 2 then p_brand || '::' || p_partkey else '' end as sname, case when p_partkey % 4 = 3 then 'void (' || (p_size + p_partkey % 2) || ')' else '' end as ssig
  from part)"""

R = "with recursive "
SQL: dict[str, str] = {
    "scope_counts": f"with {FACTS} select scope, count(*) as n from symbols group by scope",
    "traversable_edges": f"with {FACTS} select src, dst, bool_or(e.kind not in {PROVIDED}) as structural from edges e join symbols s on s.id = e.src where s.scope in ('reportable', 'indexed') group by src, dst",
    "reachable_full": f"{R}{REACH} select id from live",
    "reachable_structural": f"{R}{REACH} select id from structural",
    "provider_only": f"{R}{REACH} select id from live where id not in (select id from structural)",
    "unreachable_candidates": f"{R}{REACH} select id, kind, qualified_name from candidates",
    "classification": f"{R}{REACH} select classification, count(*) as n from candidates group by classification",
    "summary_counters": f"""{R}{REACH}, api as (select symbol from roots where kind = 'public_api')
        select count(*) filter (where scope = 'reportable') as reportable_symbols, count(*) filter (where scope = 'indexed') as indexed_symbols, count(*) filter (where scope = 'external_opaque') as external_opaque_symbols,
               count(*) filter (where own) as defined, count(*) filter (where own and reachable) as reachable, count(*) filter (where own and structural) as structural, count(*) filter (where own and reachable and not structural) as provider,
               count(*) filter (where own and not reachable) as unreachable, count(*) filter (where own and not reachable and not suppressed) as actionable, count(*) filter (where own and not reachable and suppressed) as suppressed,
               count(*) filter (where own and id in (select symbol from api)) as public_api, count(*) filter (where own and reachable and id not in (select symbol from api)) as internal_live,
               count(*) filter (where own and not reachable) as internal_unreachable from state""",
    "provider_provenance": f"""{R}{REACH}, target as (select id from state where defined and scope = 'reportable' and reachable and not structural)
        select dst as symbol, src as from_symbol from edges where kind in {PROVIDED} and src in (select id from state where reachable) and dst in (select id from target)
        union select symbol, null from roots where kind in {PROVIDED} and symbol in (select id from target)""",
    "public_api": f"with {FACTS} select distinct symbol from roots join symbols on id = symbol where roots.kind = 'public_api' and scope = 'reportable'",
    "actionable_findings": f"{R}{REACH} select id, classification from candidates where not suppressed",
    "suppressed_findings": f"{R}{REACH} select id, classification from candidates where suppressed",
    "escape_evidence_counts": f"{R}{REACH} select id, escaped::bigint as escapes, (1 + (classification <> 'likely_dead')::bigint)::bigint as evidence from candidates",
    "scc_membership": f"{R}{STRONG} select id, scc from strong",
    "scc_sizes": f"{R}{STRONG} select members, count(*) as n from (select scc, count(*) as members from strong group by scc) group by members",
    "condensation_edges": f"{R}{STRONG} select distinct a.scc as src, b.scc as dst from induced join strong a on a.id = src join strong b on b.id = dst where a.scc <> b.scc",
    "component_ids": f"""{R}{STRONG}{WEAK_TABLES},
        members as (select s.scc, w.component, w.id, w.qualified_name, w.signature, coalesce(w.file, '') as file, w.begin_line from strong s join weak w on w.id = s.id),
        firsts as (select * from members qualify row_number() over (partition by scc order by qualified_name, signature) = 1),
        ids as (select scc, component, row_number() over (order by file, begin_line, id) - 1 as scc_id from firsts),
        lows as (select *, min(scc_id) over (partition by component) as low from ids)
        select scc, scc_id, dense_rank() over (order by low) - 1 as weak_id from lows""",
    "weak_components": f"{R}{WEAK} select id, component from weak",
    "loc_by_component": f"{R}{WEAK}" + lines("select * from weak", "component"),
    "loc_by_file": f"{R}{REACH}" + lines("select * from candidates where file is not null", "file"),
    "ownership_type": owned("class_name"),
    "ownership_file": owned("file"),
    "ownership_directory": owned("(case when file like '%/%' then regexp_replace(file, '/[^/]*$', '') else '' end)"),
    "component_members": f"{R}{WEAK} select component, count(*) as members, count(*) filter (where not suppressed) as actionable, count(*) filter (where suppressed) as suppressed from weak group by component",
    "symbol_merge": f"""with {BATCHES}
        select id, coalesce(max(nullif(name, '')), '') as name, coalesce(max(nullif(qualified_name, '')), '') as qualified_name, min(kind) as kind, bool_or(internal_linkage) as internal_linkage, arg_max(scope, rank) as scope,
               bool_or(defined) as defined, bool_or(is_virtual) as is_virtual, first(file order by defined desc, rank desc, file, line) as file, first(line order by defined desc, rank desc, file, line) as line
        from batches group by id""",
    "merge_conflicts": f"""with {BATCHES}, changed as (select id, case when (id + suppkey) % 50 = 0 then 'synthetic' else kind end as kind, case when (id + suppkey) % 40 = 1 then 'other' else name end as name from batches)
        select id, 'kind' as field from changed group by id having count(distinct kind) > 1 union all select id, 'name' from changed group by id having count(distinct nullif(name, '')) > 1""",
    "selector_resolution": f"""with {SELECTORS}
        select selector, count(s.id) as matches, case when count(s.id) = 1 then min(s.id) end as id
        from selectors left join symbols s on (sid = '' or s.id::varchar = sid) and (slink = '' or s.linkage_name = slink) and (sname = '' or s.qualified_name = sname) and (ssig = '' or s.signature = ssig) group by selector""",
    "manual_roots": f"""with {FACTS}, requests as (
          select distinct case p_partkey % 3 when 0 then p_partkey::varchar when 1 then 'sym:' || p_partkey else p_brand || '::' || (p_partkey + p_partkey % 2) end as request from part)
        select request, id from requests left join symbols on request in (qualified_name, linkage_name, id::varchar)""",
    "dangling_edges": f"with {FACTS} select src, dst, kind from edges where src not in (select id from symbols where id % 37 <> 0) or dst not in (select id from symbols where id % 37 <> 0)",
    "duplicate_facts": f"with {FACTS} select kind, count(*) as n from edges group by kind",
    "dense_ids": f"with {FACTS} select linkage_name as key, row_number() over (order by linkage_name) - 1 as dense_id from symbols",
    "stable_key": f"""with {FACTS}, parts as (
          select id, case id % 3 when 0 then 'linkage' when 1 then 'usr' else 'fallback' end as anchor, case id % 3 when 0 then linkage_name when 1 then 'usr-é:' || name else qualified_name || '|' || signature end as v, coalesce(file, '') as unit from symbols)
        select id, 'reachlake-symbol-v1|configuration=5:debug|anchor=' || strlen(anchor) || ':' || anchor || '|value=' || strlen(v) || ':' || v || '|translation_unit=' || strlen(unit) || ':' || unit as stable_key from parts""",
    "class_closure": "with recursive up(node, ancestor) as (select p_partkey, p_partkey // 2 from part where p_partkey > 0 union select u.node, u.ancestor // 2 from up u where u.ancestor > 0) select node, ancestor from up",
    "virtual_dispatch": """with recursive up(node, ancestor) as (select p_partkey, p_partkey // 2 from part where p_partkey > 0 union select u.node, u.ancestor // 2 from up u where u.ancestor > 0)
        select distinct a.p_partkey as src, b.p_partkey as dst from up join part a on a.p_partkey = ancestor join part b on b.p_partkey = node
        where node <> ancestor and a.p_partkey % 3 = 0 and a.p_partkey % 5 = b.p_partkey % 5 and a.p_partkey % 2 = b.p_partkey % 2""",
    "construct_suffix_join": f"""with {FACTS}, classes as (select id as dst, 'lib::m' || (id % 7) || '::C' || (id % 50) as class_name from symbols where kind in ('constructor', 'destructor')),
        used as (select id as src, case when id % 2 = 0 then 'm' || (id % 7) || '::C' || (id % 50) else 'C' || (id % 50) end as type from symbols)
        select src, dst from used join classes on class_name = type or ends_with(class_name, ':' || type)""",
    "target_closure": """with recursive deps as (select 's' || s_suppkey as a, 'n' || s_nationkey as b from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
        closed(target) as (select 's' || s_suppkey from supplier union select b from closed join deps on a = target) select target from closed""",
    "command_preference": """with c as (select o_custkey, o_orderkey, o_orderstatus, coalesce(try_cast(o_orderpriority[1] as integer), 9) as p from orders), best as (select * from c qualify p = min(p) over (partition by o_custkey))
        select o_custkey as source, min(o_orderkey) as command, min(p)::bigint as preference, count(distinct o_orderstatus) > 1 as ambiguous from best group by o_custkey""",
    "diff_transitions": f"{R}{DIFF} select id, change, baseline_classification, current_classification, current_suppressed from diffs",
    "diff_counters": f"""{R}{DIFF} select count(*) filter (where change = 'new_symbol') as new_symbol, count(*) filter (where change = 'newly_unreachable') as newly_unreachable, count(*) filter (where change = 'removed') as removed,
        count(*) filter (where change = 'became_reachable') as became_reachable, count(*) filter (where change in ('new_symbol', 'newly_unreachable') and not current_suppressed and current_classification is not null) as policy_matches from diffs""",
    "policy_matches": f"{R}{DIFF} select id, change from diffs where change in ('new_symbol', 'newly_unreachable') and not current_suppressed and current_classification in ('dead', 'likely_dead')",
    "offset_to_line": r"""with asked as (select distinct doc_id as file, (l_partkey * 31 + l_linenumber) % (strlen(text) + 1) as "offset" from lineitem join documents on doc_id = l_orderkey % (select count(*) from documents where text is not null) where text is not null),
        starts as (select doc_id as file, pos as line, coalesce(sum(strlen(piece) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as at
                   from (select doc_id, unnest(string_split(text, chr(10))) as piece, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null))
        select a.file, a."offset", s.line from asked a asof join starts s on s.file = a.file and a."offset" >= s.at""",
    "fact_bytes": f"""with {FACTS}
        select 'symbols' as fact, count(*) as n, sum(strlen(linkage_name) + strlen(name) + strlen(qualified_name) + strlen(class_name) + strlen(signature) + coalesce(strlen(file), 0) + 12)::bigint as bytes from symbols
        union all select 'edges', count(*), (20 * count(*))::bigint from edges union all select 'roots', count(*), (12 * count(*))::bigint from roots
        union all select 'escapes', count(*), (20 * count(*))::bigint from escapes union all select 'suppressions', count(*), (8 * count(*))::bigint from suppressions""",
    "dependency_staleness": """with manifest as (select distinct l_orderkey as unit, l_partkey as path, (l_orderkey + l_partkey) % 2 = 0 as is_primary from lineitem),
        checked as (select unit, is_primary, path % 41 <> 0 and path % 15 <> 7 as same from manifest)
        select valid, count(*) as units from (select unit, bool_and(same) and bool_or(is_primary) as valid from checked group by unit) group by valid""",
}
