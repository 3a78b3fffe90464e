"""SQL forms of the adapter views and shared SQL fragments for the DuckDB oracle.

Where a rule has more than one form, the oracle takes another than the Spark plan (window
functions where that side uses aggregates and joins). The tag parser's and the pair fold's SQL
follow the same steps as the plans; unit tests check those two against hand-written results.
"""

from __future__ import annotations

from credline.schemas import NA_LITERALS, WS_CLASS

WS = WS_CLASS + "+"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}'), lambda x: x <> '')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}|{WS}$', '', 'g')"


def clean(expr: str) -> str:
    lines = f"list_filter(string_split({expr}, chr(10)), lambda l: regexp_matches(l, '\\p{{L}}'))"
    words = (f"list_transform({lines}, lambda l: list_filter({tokens('l')}, "
             f"lambda w: (length(w) > 1 and regexp_matches(w, '\\p{{L}}')) or w = '&'))")
    return f"array_to_string(flatten({words}), ' ')"


def norm_key(expr: str) -> str:
    return f"regexp_replace(lower({strip(expr)}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def label(expr: str) -> str:
    return (f"case when {expr} in ('I','N','Y') then 'chyron' "
            f"when {expr} = 'C' then 'credits' end")


NA_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in NA_LITERALS)

VIEW_SQL = {
    "v_ocr_rows": """
select d.doc_id as row_id, 'cpb-aacip-' || d.source as guid, d.doc_id*1000 as time_point,
       case d.lang when 'en' then 'I' when 'fr' then 'N' when 'es' then 'C' else 'S' end as scene_code,
       cast(d.n_chars % 101 as double)/100.0 as confidence, d.text as textdocument,
       l.doc_id is not null as annotated, coalesce(l.quality=1,false) as ocr_accepted,
       coalesce(l.toxic=1,false) as deleted
from documents d left join labels l on d.doc_id=l.doc_id""",
    "v_mapped": f"""
select *, {label('scene_code')} as scene_label from v_ocr_rows
where {label('scene_code')} is not null""",
    "v_frames": """
select 'cpb-aacip-' || cast(o_custkey as varchar) as guid, o_orderkey as frame_num,
       o_orderpriority as role, o_orderstatus<>'O' as annotated,
       case when o_orderstatus='P' then case when o_orderkey % 3 = 0 then 'no text in image' else 'DUPLICATE' end end
         as skip_reason from orders""",
    "v_timeframes": """
select 'cpb-aacip-' || cast(o_custkey as varchar) as guid, o_orderkey as tf_id,
       (o_orderkey*10)%900 as start_frame, (o_orderkey*10)%900 + o_custkey%60 as end_frame
from orders""",
    "v_box": """
select l_orderkey as guid, cast(l_linenumber as bigint) as frame_num, l_partkey as box_idx,
       case when l_discount = 0 then cast('NaN' as double) else l_quantity/50.0 end as confidence,
       l_extendedprice/100.0 as x0, l_extendedprice/50.0 as x1,
       l_tax*100.0 as y0, l_tax*100.0 + l_quantity as y1
from lineitem""",
    "v_path_rows": """
select 'cpb-aacip-src' || cast(page_id%15 as varchar) as guid, page_id as file_ord, url as path
from pages""",
    "v_review_events": """
select user_id as row_id, event_id as seq, ts,
       case event_type when 'click' then 'swap' when 'error' then 'reject'
                       when 'purchase' then 'delete' when 'signup' then 'submit' else 'undo' end as action
from events""",
    "v_adjudication_events": """
select user_id as row_id, event_id as seq, ts,
       case event_type when 'signup' then 'accept' when 'error' then 'reject'
                       when 'click' then 'edit' when 'view' then 'undo' else 'other' end as action,
       case when event_type = 'click' and event_id % 4 <> 0
            then 'edited@BR:1 text@BF:1 ' || cast(event_id as varchar) || '@O' end as payload
from events""",
    "v_alignment": """
select doc_id, 'v_' || source as view_id,
       case when doc_id%5=0 then 'bb_' else 'tp_' end || cast(doc_id as varchar) as source_id,
       case when doc_id%7=0 then 'tok_' else 'td_' end || cast(doc_id as varchar) as target_id
from documents""",
    "v_credits": """
select conv_id as guid, turn as frame_num, role, text as filler, role='assistant' as continuing
from conversations""",
    "v_tagged": f"""
select doc_id, array_to_string(toks, ' ') as cleaned_text,
       array_to_string(list_filter(list_transform(toks, lambda t, i: t || '@' ||
           case when doc_id % 17 = 0 and i-1 = 3 then 'IF:9'
                when (i-1) % 6 = 5 then 'O'
                else (case (i-1) % 6 when 0 then 'BR:' when 1 then 'IR:' when 2 then 'BF:'
                                     when 3 then 'IF:' else 'BF:' end)
                     || cast((i-1) // 6 + 1 as varchar) end),
         lambda x, i: not (doc_id % 13 = 0 and i-1 = 5)), ' ') as tagged
from (select doc_id, {tokens('text')} as toks from documents)""",
}

# Views that depend on other views.
VIEW_DEPS = {"v_mapped": ["v_ocr_rows"]}


def with_views(views: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    names: list[str] = []
    for v in views:
        for dep in VIEW_DEPS.get(v, []):
            if dep not in names:
                names.append(dep)
        if v not in names:
            names.append(v)
    ctes = [f"{n} as ({VIEW_SQL[n]})" for n in names]
    ctes += [f"{n} as ({q})" for n, q in (extra or [])]
    return "with " + ",\n".join(ctes) + "\n" + body
