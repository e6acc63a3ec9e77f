"""The page tree in plain SQL, for the twins of queries over element texts, paths and signatures.

Tokens are cut by one pattern, a recursive query keeps each page's stack of open tags, and everything about an element is
taken from the tokens between its start and its end, by brute force.
"""

from __future__ import annotations

#: Blanks at the ends of a text.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'wbr'"


def unescaped(text: str) -> str:
    for name, value in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{value}')"
    return text


TREE = f"""recursive toks as (select page_id, tok, i,
  case when tok like '<!%' then 'x' when tok ilike '<script%' or tok ilike '<style%' then 's' when tok like '</%' then 'c'
   when tok like '<%' and lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) in ({VOID}) then 'v' when tok like '<%' then 'o' else 't' end as kind,
  lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) as tag from (
  select page_id, unnest(l) as tok, generate_subscripts(l, 1) as i from (select page_id, regexp_extract_all(html,
   '(?s)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-zA-Z][^>]*>|[^<]+') as l from pages))),
 walk as (select page_id, 0 as i, 0 as before, []::varchar[] as stack from pages
  union all select w.page_id, w.i + 1, len(stack), case when kind = 'o' then list_append(stack, tag)
   when kind = 'c' and list_contains(stack, tag) then stack[1 : len(stack) - list_position(list_reverse(stack), tag)] else stack end
  from walk w join toks t on t.page_id = w.page_id and t.i = w.i + 1),
 steps as materialized (select t.*, w.before, len(w.stack) as after from toks t join walk w on w.page_id = t.page_id and w.i = t.i),
 nodes as materialized (select *, row_number() over (partition by page_id order by i, sub) - 1 as nid from (
  select page_id, i, 0 as sub, before as depth, case kind when 't' then 't' when 'x' then 'c' else 'e' end as kind, tag, tok,
   case when kind = 't' then {unescaped('tok')} end as text, kind as was from steps where kind <> 'c'
  union all select page_id, i, 1, before + 1, 't', '', tok, regexp_extract(tok, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1), 't' from steps
   where kind = 's' and regexp_extract(tok, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1) <> '')),
 closed as (select n.page_id, n.nid, min(s.i) as stop from nodes n join steps s on s.page_id = n.page_id and s.i > n.i and s.after <= n.depth
  where n.was = 'o' group by all),
 elements as materialized (select n.page_id, n.nid, n.i, n.depth, n.tag, n.was, regexp_extract(n.tok, '^<[^>]* class="([^"]*)"', 1) as class,
  case when n.was = 'o' then coalesce(c.stop, 1000000000) when n.was = 's' then n.i + 1 else n.i end as stop
  from nodes n left join closed c on c.page_id = n.page_id and c.nid = n.nid where n.kind = 'e'),
 inner_strings as (select e.page_id, e.nid, e.depth, t.depth as at_depth, t.nid as string_id, t.text from elements e
  join nodes t on t.page_id = e.page_id and t.kind = 't' and t.nid > e.nid and t.i < e.stop),
 contents as materialized (select page_id, nid, trim(string_agg(text, '' order by string_id), {BLANKS}) as content,
  arg_min(text, string_id) filter (where at_depth = depth + 1) as own from inner_strings group by all),
 texts as (select * from contents where trim(own, {BLANKS}) <> '')"""

#: Children, signatures and repeated ones, most frequent first.
SIGNATURES = """children as (select e.page_id, e.nid, count(*) as child_count from elements e
  join elements c on c.page_id = e.page_id and c.nid > e.nid and c.i < e.stop and c.depth = e.depth + 1 group by all),
 signed as (select e.page_id, e.nid, e.tag, case when class = '' then []::varchar[] else list_sort(string_split(class, ' ')) end as classes,
  coalesce(child_count, 0) as child_count, least(8, length(coalesce(content, '')) // 30) as text_bucket
  from elements e left join children c on c.page_id = e.page_id and c.nid = e.nid left join contents t on t.page_id = e.page_id and t.nid = e.nid),
 grouped as (select page_id, tag, classes, child_count, text_bucket, count(*) as count, min(nid) as first_node, list(nid order by nid) as ids
  from signed group by all having count(*) > 1),
 repeats as (select *, cast(row_number() over (partition by page_id order by count desc, first_node) as integer) as rank from grouped)"""
SIGNATURE_JSON = """'{"tag":"' || tag || '","classes":' || to_json(classes) || ',"child_count":' || child_count || ',"text_bucket":' || text_bucket || '}'"""

#: Absolute paths: the place among siblings of the same tag is given where there are several.
PATHS = """above as (select e.page_id, e.nid, e.tag, e.depth, max(p.nid) as parent from elements e
  left join elements p on p.page_id = e.page_id and p.nid < e.nid and p.stop > e.i and p.depth = e.depth - 1 group by all),
 placed as (select *, count(*) over (partition by page_id, parent, tag) as alike,
  row_number() over (partition by page_id, parent, tag order by nid) as place from above),
 named as (select *, '/' || tag || case when alike = 1 then '' else '[' || place || ']' end as step from placed),
 paths as (select page_id, nid, step as xpath from named where parent is null
  union all select n.page_id, n.nid, p.xpath || n.step from paths p join named n on n.page_id = p.page_id and n.parent = p.nid)"""


def fragment(page: str, node: str) -> str:
    """Source of an element: its tokens, with its own end tag only if that is what closes it."""
    return f"""(select string_agg(s.tok, '' order by s.i) from steps s join elements x on x.page_id = s.page_id
   where x.page_id = {page} and x.nid = {node} and s.i >= x.i and (s.i < x.stop and (x.was = 'o' or s.i = x.i) or x.was = 'v' and s.i = x.i
    or s.i = x.stop and x.was = 'o' and s.after = x.depth))"""


def tree(sql: str, *more: str) -> str:
    return "with " + ", ".join([TREE, *more]) + " " + sql
