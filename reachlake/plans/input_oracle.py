"""What the queries of input_queries give, said in SQL over the driver's tables: from what the inputs mean, without reading them."""

from __future__ import annotations

from reachlake.plans.oracle import DIFF, FACTS, R
from reachlake.streaming.store import STORE_VERSION

USES = """
pairs as (select distinct l_suppkey as s, l_partkey as p from lineitem),
uses as (select s, p, lead(p) over (partition by s order by p) as q from pairs),
inner_uses as (select distinct p, q from uses where q is not null and p % 10 <> 9),
called as (select p as src, q as dst, 'direct_call' as kind from inner_uses where p % 6 in (0, 2, 4)),
escaped as (
  select q as id, p as from_id, 'address_taken' as kind from inner_uses where p % 6 in (1, 2, 3, 4)
  union all select q, p, 'callable_object' from inner_uses where p % 6 in (2, 3)),
started as (select distinct min(p) as id, 'global_initializer' as kind from pairs where s % 2 = 1 group by s)"""

PLAIN = "replace(p_brand, '#', '')"

SQL: dict[str, str] = {
    "extracted_symbols": f"""with {USES}
        select distinct p as id, case p % 10 when 9 then 'external_opaque' when 8 then 'indexed' else 'reportable' end as scope, p % 6 <> 5 and p % 10 <> 9 as defined, p + 1 as line from pairs
        where p % 10 <> 9 or p in (select dst from called) or p in (select id from escaped) or p in (select id from started)""",
    "extracted_edges": f"with {USES} select * from called",
    "extracted_roots": f"with {USES} select * from started",
    "extracted_escapes": f"with {USES} select * from escaped",
    "extracted_places": """with pairs as (select distinct l_suppkey as s, l_partkey as p, '/p/src/s' || l_suppkey || '.cpp' as unit, l_partkey % 5 as k from lineitem),
        points as (select *, ':0:1:' || p || ':4' as unknown, case k when 3 then '/p/include/h.h' else unit end || ':' || (p + 1) || ':6:' || p || ':2' as loc, unit || ':' || (p + 1) || ':1:' || p as start from pairs)
        select s, p, case when k = 4 then 'external_opaque' when k = 3 then 'indexed' else 'reportable' end as scope, k <> 4 as defined,
               case k when 1 then '/p/include/m.h:7:3:100:3' when 4 then unknown else loc end as spelling_location,
               case k when 1 then '/p/include/m.h:6:3:90:4' when 3 then loc when 4 then unknown else start || ':4' end as spelling_begin,
               case k when 1 then '/p/include/m.h:8:3:140:1' when 0 then unit || ':' || (p + 3) || ':1:' || (p + 50) || ':1' when 3 then '/p/include/h.h:' || (p + 3) || ':1:' || (p + 50) || ':1' when 4 then unknown else start || ':4' end as spelling_end,
               case when k = 1 then start || ':6' end as expansion_location, case when k = 1 then start || ':6' end as expansion_begin, case when k = 1 then start || ':6' end as expansion_end from points""",
    "exported_roots": "select distinct l_partkey as id, 'public_api' as kind from lineitem where l_partkey % 6 <> 5 and l_partkey % 10 <> 9 and l_suppkey % 4 <> 3 and l_suppkey % 3 <> 0",
    "removed_symbols": f"""{R}{DIFF}
        select d.id, s.qualified_name, s.signature, s.linkage_name, s.kind, s.scope, s.file, s.begin_line as line from diffs d join symbols s on s.id = d.id where change = 'removed'""",
    "owning_factories": """with pairs as (select distinct l_suppkey as s, l_partkey as p from lineitem where l_partkey % 20 % 2 = 0 and l_partkey % 3 <> 2)
        select case when p % 3 = 0 then 'made' else 'taken' end as how, count(*) as sources, count(distinct p % 20) as classes from pairs group by 1
        union all select 'create' || (p % 7), null, count(distinct p % 20) from pairs where p % 3 = 1 group by 1""",
    "artifact_round_trip": f"with {USES} select * from called",
    "type_spellings": f"""select p_partkey as id, {PLAIN} as plain,
        case when p_partkey % 3 = 2 or p_partkey % 5 = 0 then null else {PLAIN} end as owned from part""",
    "command_words": """select o_orderkey as id, 'cc|-DA=' || o_orderpriority || ' x|-DB="' || o_orderstatus || '"|-DC=a b\\|' || o_orderkey as words from orders""",
    "analysis_commands": """select o_orderkey as id,
        case when o_orderkey % 3 = 0 then 'arm-linux-g++-13.2' else 'clang++' end || '|-DN=' || o_orderkey || case when o_orderkey % 2 = 0 then '' else '|-include-pch|../pch.h' end || '|/p/build/f' || o_orderkey || '.cpp' as arguments,
        case when o_orderkey % 2 = 0 then '' else '/p/pch.h' end as inputs from orders""",
    "compile_commands": """with numbered as (select s_suppkey as k, 't' || s_nationkey as own, row_number() over (order by s_suppkey) - 1 as i from supplier),
        entries as (select k, 'other' as target, 2 * i as index from numbered union all select k, own, 2 * i + 1 from numbered)
        select index, '/p/build' as directory, '/p/src/s' || k || '.cpp' as file, '/p/build/CMakeFiles/' || target || '.dir/s' || k || '.o' as output,
               case when k % 2 = 0 then 'g++|-c|../src/s' || k || '.cpp|-o|CMakeFiles/' || target || '.dir/s' || k || '.o|-DX=' || target
                    else 'g++|-c|-o|CMakeFiles/' || target || '.dir/s' || k || '.o|-DX=' || target || '|../src/s' || k || '.cpp' end as arguments from entries""",
    "manifest_sources": """select 'debug' as configuration, 'n' || n_nationkey as id, '/p/src/s' || s_suppkey || '.cpp' as path, 't' || n_nationkey as name, case when n_nationkey = 0 then 'executable' else 'static_library' end as kind,
        '/p/include/t' || n_nationkey || '.h' as header, '/p/build/t' || n_nationkey || '.a' as artifact from supplier join nation on n_nationkey = s_nationkey""",
    "target_commands": """with recursive linked(n) as (select 0 union select 2 * n + 1 from linked where 2 * n + 1 < (select count(*) from nation)),
        numbered as (select *, 2 * (row_number() over (order by s_suppkey) - 1) + 1 as index from supplier)
        select index, '/p/src/s' || s_suppkey || '.cpp' as file from numbered where s_nationkey in (select n from linked)""",
    "depfile_dependencies": """select s_suppkey::varchar as path, '/p/src/s' || s_suppkey || '.cpp' as dependency from supplier
        union all select s_suppkey::varchar, '/p/include/a b' || s_nationkey || '.h' from supplier union all select s_suppkey::varchar, 'c\\d.h' from supplier""",
    "file_scopes": """select p_partkey as id, case p_partkey % 5 when 0 then 'reportable' when 1 then 'excluded' when 2 then 'indexed' else 'external_opaque' end as scope,
        case p_partkey % 5 when 0 then 'src/' || p_partkey || '.cpp' when 1 then 'src/gen/' || p_partkey || '.cpp' when 2 then 'lib/' || p_partkey || '.cpp' when 3 then '/p2/src/' || p_partkey || '.cpp' else '' end as shown from part""",
    "display_texts": f"""with {FACTS}
        select id, case when id % 11 = 0 then linkage_name else qualified_name || ' ' || signature end as shown,
               case when file is null then '<unknown>' when id % 4 = 0 then file when id % 3 = 0 then file || ':' || begin_line else file || ':' || begin_line || ':' || (id % 3) end as place, 'reachlake.' || kind || '.' || scope as rule from symbols""",
    "fallback_identities": f"""with {FACTS}
        select id, case when class_name = '' then '' else class_name || '::' end || name || '|' || signature || '|' || coalesce(file, '') || ':' || begin_line as anchor, case when id % 3 = 2 then 'fallback' else 'stable' end as quality,
               id % 2 = 0 or id % 5 = 0 or id % 7 = 0 as internal from symbols""",
    "export_visibility": "select p_partkey as id, case p_partkey % 4 when 0 then true when 1 then false when 2 then true else p_partkey % 3 <> 0 end as exported from part",
    "provider_facts": f"""with {FACTS},
        more as (select symbol, kind, false as added from roots union select id, 'provider', true from symbols where id % 50 = 3 union select id, 'public_api', true from symbols where id % 60 = 4)
        select kind, count(*) as n from more group by kind
        union all select 'suppression', (select count(*) from suppressions) + (select count(*) from symbols where id % 70 = 5)""",
    "uri_paths": "select p_partkey as id, 'src/' || replace(p_brand, '#', '%23') || '/%C3%A9%20' || replace(p_name, ' ', '%20') || '.cpp' as uri from part",
    "unit_keys": f"""with parts as (select s_suppkey as id, [['store', '{STORE_VERSION}'], ['arguments', s_name], ['configuration', 'debug'], ['file', '/p/src/s' || s_suppkey || '.cpp']] as p from supplier)
        select id, sha256(list_aggregate(list_transform(p, lambda x: strlen(x[1]) || ':' || x[1] || strlen(x[2]) || ':' || x[2]), 'string_agg', '')) as unit_key from parts""",
    "store_reuse": "select s_suppkey::varchar as unit, case when s_nationkey % 5 = 0 then 'second' else 'first' end as made from supplier",
    "store_stream": """select p_brand as unit, case when right(p_brand, 1) in ('1', '2') then 'first stream again' when right(p_brand, 1) in ('3', '4') then 'second stream' else 'batch run' end as made, count(*) as n, count(distinct p_partkey) as n_keys
        from part group by all""",
    "sarif_results": f"""{R}{DIFF}
        select d.id, 'reachlake.' || change || '.' || current_classification as rule, replace(s.file, '#', '%23') as uri from diffs d join symbols s on s.id = d.id
        where change in ('new_symbol', 'newly_unreachable') and not current_suppressed and current_classification in ('dead', 'likely_dead')""",
}
