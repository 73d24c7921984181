"""The Markdown renderer once more, in SQL: the twin of ``operators.render`` for the queries that render documents.

Documents are flattened to nodes; a pass downwards says how each node is visited (as Markdown, as HTML within a table
cell, or as a part of a table or list) and where it stands in lists; a pass upwards puts together, level by level, what
the children gave. ``chr(1)`` stands for a blank line that is wanted here, and is settled where a text is complete.
"""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COMPLEX = "('heading','codeBlock','bulletList','orderedList','taskList','decisionList')"
HTML_LISTS = "('bulletList','orderedList','taskList','decisionList')"
#: Types that do not visit their children.
LEAVES = "('text','rule','hardBreak','mention','emoji','date','inlineCard','blockCard','status','media','mediaInline','codeBlock')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _any_case(j: str, key: str) -> str:
    found = ", ".join(f"json_extract({j}, '$.{k}')" for k in (key, key.capitalize(), key.upper()))
    return f"coalesce({found})"


def _attr(key: str, of: str = "a") -> str:
    at = f"json_extract({of}, '$.{key}')"
    return f"CASE WHEN json_type({at}) = 'VARCHAR' THEN {at} ->> '$' END"


def _int(key: str, fallback: int) -> str:
    at = f"json_extract(a, '$.{key}')"
    return f"CASE WHEN json_type({at}) IN ('BIGINT','UBIGINT','DOUBLE') THEN CAST(trunc(CAST({at} ->> '$' AS DOUBLE)) AS BIGINT) ELSE {fallback} END"


def _settle(x: str) -> str:
    once = f"regexp_replace(regexp_replace({x}, '\\x01+', chr(1), 'g'), '^\\x01', '')"
    return f"replace(replace(replace({once}, chr(10) || chr(10) || chr(1), chr(10) || chr(10)), chr(10) || chr(1), chr(10) || chr(10)), chr(1), chr(10) || chr(10))"


def _lines(x: str, first: str, rest: str, blank: str) -> str:
    """Each line of a text behind a prefix; blank further lines by a rule of their own."""
    split = f"string_split(regexp_replace({x}, '\\n+$', ''), chr(10))"
    follow = f"list_transform({split}[2:], lambda l: CASE WHEN {strip('l')} = '' THEN {blank} ELSE {rest} || l END || chr(10))"
    return f"concat({first}, {split}[1], chr(10), array_to_string({follow}, ''))"


_MONTH = "monthname(make_timestamp(ms * 1000))"
_PARAMS = "CASE WHEN json_type(json_extract(a, '$.macroParams')) = 'OBJECT' THEN json_extract(a, '$.macroParams') ELSE json_extract(a, '$.parameters') END"


def _param(key: str) -> str:
    at = f"json_extract({_PARAMS}, '$.{key}')"
    value = f"json_extract({at}, '$.value')"
    return f"CASE json_type({at}) WHEN 'VARCHAR' THEN {at} ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type({value}) = 'VARCHAR' THEN {value} ->> '$' END END"


_TABLE_ROWS = "list_transform(string_split(c, chr(4))[2:], lambda r: string_split(r, chr(3))[2:])"
_WIDTH = f"coalesce(list_max(list_transform({_TABLE_ROWS}, lambda r: len(r))), 0)"
_GRID = f"""list_transform({_TABLE_ROWS}, lambda r: '|' || array_to_string(list_transform(r, lambda x: ' ' || x || ' |'), '') || repeat('  |', {_WIDTH} - len(r)) || chr(10))"""

#: Markdown of a node from its attributes ``a``, its text ``t``, and what its children gave: as is (c), and settled (i).
_MARKDOWN = f"""CASE
  WHEN type = 'text' THEN marked
  WHEN type = 'paragraph' THEN CASE WHEN {strip('i')} = '' THEN '' ELSE chr(1) || i || chr(10) || chr(10) END
  WHEN type = 'heading' THEN chr(1) || repeat('#', least(greatest({_int('level', 1)}, 1), 6)) || ' ' || c || chr(10) || chr(10)
  WHEN type IN ('bulletList','taskList','decisionList','orderedList') THEN c || chr(10)
  WHEN type = 'listItem' THEN {_lines('i', "repeat('  ', greatest(deep - 1, 0)) || CASE WHEN owner IS NULL THEN '- ' ELSE nth || '. ' END", "repeat('  ', greatest(deep - 1, 0)) || repeat(' ', CASE WHEN owner IS NULL THEN 2 ELSE len(CAST(nth AS VARCHAR)) + 2 END)", "''")}
  WHEN type IN ('taskItem','decisionItem') THEN repeat('  ', greatest(deep - 1, 0)) || CASE WHEN {_attr('state')} = CASE type WHEN 'taskItem' THEN 'DONE' ELSE 'DECIDED' END THEN '- [x] ' ELSE '- [ ] ' END || regexp_replace(i, '\\n+$', '') || chr(10)
  WHEN type = 'caption' THEN CASE WHEN {strip('i')} = '' THEN '' ELSE '*' || {strip('i')} || '*' || chr(10) END
  WHEN type = 'codeBlock' THEN '```' || coalesce({_attr('language')}, '') || chr(10) || c || chr(10) || '```' || chr(10) || chr(10)
  WHEN type = 'blockquote' THEN {_lines('i', "'> '", "'> '", "'> ' || l")} || chr(10)
  WHEN type = 'panel' THEN {_lines('i', f"'> ' || CASE WHEN coalesce({_attr('panelType')}, '') = '' THEN '' ELSE '**' || upper(left({_attr('panelType')}, 1)) || substr({_attr('panelType')}, 2) || ':** ' END", "'> '", "'> ' || l")} || chr(10)
  WHEN type = 'rule' THEN '---' || chr(10) || chr(10)
  WHEN type IN ('expand','nestedExpand') THEN CASE WHEN coalesce({_attr('title')}, '') = '' THEN '' ELSE '**' || {_attr('title')} || '**' || chr(10) || chr(10) END || c
  WHEN type IN ('mediaSingle','mediaGroup') THEN chr(1) || c || chr(1)
  WHEN type IN ('media','mediaInline') THEN CASE WHEN coalesce({_attr('id')}, '') = '' THEN '' ELSE '![' || coalesce({_attr('alt')}, {_attr('id')}) || '](attachment://' || {_attr('id')} || ')' END
  WHEN type = 'hardBreak' THEN chr(10)
  WHEN type = 'mention' THEN coalesce({_attr('text')}, '')
  WHEN type = 'emoji' THEN coalesce(nullif({_attr('text')}, ''), {_attr('shortName')}, '')
  WHEN type = 'date' THEN CASE WHEN ms > 0 THEN day(make_timestamp(ms * 1000)) || ' ' || {_MONTH} || ' ' || year(make_timestamp(ms * 1000)) ELSE coalesce({_attr('timestamp')}, '') END
  WHEN type = 'inlineCard' THEN CASE WHEN coalesce({_attr('url')}, '') = '' THEN '' ELSE '[' || {_attr('url')} || '](' || {_attr('url')} || ')' END
  WHEN type = 'blockCard' THEN CASE WHEN coalesce({_attr('url')}, '') = '' THEN '' ELSE chr(10) || '[' || {_attr('url')} || '](' || {_attr('url')} || ')' || chr(10) || chr(10) END
  WHEN type = 'status' THEN CASE WHEN coalesce({_attr('text')}, '') = '' THEN '' ELSE '**' || {_attr('text')} || '**' END
  WHEN type IN ('extension','inlineExtension','bodiedExtension') AND {_attr('extensionKey')} = 'jira' THEN coalesce('[' || ticket || '](https://jira.atlassian.net/browse/' || ticket || ')', '')
  WHEN type = 'table' AND html THEN '<table>' || chr(10) || c || '</table>' || chr(10)
  WHEN type = 'table' THEN CASE WHEN c = '' THEN '' ELSE {_GRID}[1] || '|' || repeat(' --- |', {_WIDTH}) || chr(10) || array_to_string({_GRID}[2:], '') END || chr(10)
  ELSE c END"""

_SPANS = " || ".join(f"CASE WHEN {_int(k, 1)} > 1 THEN ' {k}=\"' || {_int(k, 1)} || '\"' ELSE '' END" for k in ("colspan", "rowspan"))
_LI_BOX = f"CASE up_type WHEN 'taskList' THEN CASE WHEN {_attr('state')} = 'DONE' THEN '[x] ' ELSE '[ ] ' END WHEN 'decisionList' THEN CASE WHEN {_attr('state')} = 'DECIDED' THEN '[x] ' ELSE '[ ] ' END ELSE '' END"

_OUTPUT = f"""CASE role
  WHEN 'md' THEN {_MARKDOWN}
  WHEN 'raw' THEN coalesce(t, '')
  WHEN 'row' THEN CASE WHEN up_html THEN '<tr>' || c || '</tr>' || chr(10) ELSE chr(4) || c END
  WHEN 'gfm' THEN chr(3) || replace(replace({strip('i')}, chr(10), ' '), '|', '\\|')
  WHEN 'tcell' THEN '<' || tag || {_SPANS} || '>' || {strip('c')} || '</' || tag || '>'
  WHEN 'li' THEN '<li>' || {_LI_BOX} || {strip('c')} || '</li>'
  WHEN 'cell' THEN CASE
    WHEN type = 'paragraph' THEN CASE WHEN {strip('i')} = '' THEN '' ELSE '<p>' || {strip('i')} || '</p>' END
    WHEN type = 'heading' THEN '<h' || least(greatest({_int('level', 1)}, 1), 6) || '>' || {strip('i')} || '</h' || least(greatest({_int('level', 1)}, 1), 6) || '>'
    WHEN type = 'codeBlock' THEN '<pre><code>' || {strip('i')} || '</code></pre>'
    WHEN type = 'orderedList' THEN '<ol>' || c || '</ol>'
    WHEN type IN {HTML_LISTS} THEN '<ul>' || c || '</ul>'
    ELSE i END
  ELSE c END"""

#: How a child is visited, by how its parent was.
_ROLE = f"""CASE
  WHEN u.role = 'md' AND u.type = 'table' THEN 'row'
  WHEN u.role = 'row' THEN CASE WHEN u.up_html THEN 'tcell' ELSE 'gfm' END
  WHEN u.role = 'tcell' OR u.role = 'li' THEN 'cell'
  WHEN u.role = 'cell' AND u.type IN {HTML_LISTS} THEN 'li'
  WHEN u.role = 'md' AND u.type = 'codeBlock' THEN 'raw'
  ELSE 'md' END"""
_STOPS = f"(u.role = 'raw' OR (u.role = 'md' AND u.type IN {LEAVES} AND u.type <> 'codeBlock') OR (u.role = 'md' AND u.jira))"

_MARK = f"{_any_case('m', 'type')} ->> '$'"
_MARK_ATTRS = _any_case("m", "attrs")
_PRIORITY = f"CASE {_MARK} WHEN 'code' THEN 0 WHEN 'subsup' THEN 1 WHEN 'link' THEN 2 WHEN 'strong' THEN 3 WHEN 'em' THEN 4 WHEN 'strike' THEN 5 WHEN 'underline' THEN 6 WHEN 'textColor' THEN 7 ELSE 99 END"
_SUB = f"CASE WHEN {_any_case(_MARK_ATTRS, 'type')} ->> '$' IN ('sub','sup') THEN {_any_case(_MARK_ATTRS, 'type')} ->> '$' END"
_HREF = f"CASE WHEN json_type(json_extract({_MARK_ATTRS}, '$.href')) = 'VARCHAR' THEN nullif(json_extract({_MARK_ATTRS}, '$.href') ->> '$', '') END"
_BEFORE = f"CASE {_MARK} WHEN 'code' THEN '`' WHEN 'subsup' THEN coalesce('<' || {_SUB} || '>', '') WHEN 'link' THEN CASE WHEN {_HREF} IS NULL THEN '' ELSE '[' END WHEN 'strong' THEN '**' WHEN 'em' THEN '_' WHEN 'strike' THEN '~~' WHEN 'underline' THEN '<u>' ELSE '' END"
_AFTER = f"CASE {_MARK} WHEN 'code' THEN '`' WHEN 'subsup' THEN coalesce('</' || {_SUB} || '>', '') WHEN 'link' THEN coalesce('](' || {_HREF} || ')', '') WHEN 'strong' THEN '**' WHEN 'em' THEN '_' WHEN 'strike' THEN '~~' WHEN 'underline' THEN '</u>' ELSE '' END"


def markdown_ctes(documents: str) -> str:
    """Common table expressions (of a WITH RECURSIVE) that end in ``rendered(k, markdown)`` for documents(k, adf); broken
    documents have no row."""
    type_, attrs, content, text, marks = (_any_case("j", k) for k in ("type", "attrs", "content", "text", "marks"))
    bad = " OR ".join(f"coalesce(json_type({x}), 'NULL') NOT IN ('NULL', '{kind}')" for x, kind in ((type_, "VARCHAR"), (attrs, "OBJECT"), (content, "ARRAY"), (text, "VARCHAR"), (marks, "ARRAY")))
    return f"""r_json AS (SELECT k, CASE WHEN json_valid(adf) THEN CAST(adf AS JSON) END AS j FROM {documents}),
r_root AS (SELECT k, {_any_case('j', 'content')} AS kids FROM r_json WHERE json_type(j) IN ('OBJECT', 'NULL')),
r_flat(k, path, up, pos, lvl, j) AS (
  SELECT k, '', NULL::VARCHAR, 0, 0, CAST(json_object('type', '#root', 'content', kids) AS JSON) FROM r_root
  UNION ALL
  SELECT k, path || '.' || (i - 1), path, i, lvl + 1, CASE WHEN json_type(kids[i]) = 'NULL' THEN CAST('{{}}' AS JSON) ELSE kids[i] END
  FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS i FROM (
    SELECT k, path, lvl, CAST({content} AS JSON[]) AS kids FROM r_flat WHERE json_type({content}) = 'ARRAY'))),
r_bad AS (SELECT DISTINCT k FROM r_flat WHERE json_type(j) <> 'OBJECT' OR {bad}
  OR CASE WHEN json_type({marks}) = 'ARRAY' THEN list_bool_or(list_transform(CAST({marks} AS JSON[]), lambda m: json_type(m) NOT IN ('OBJECT', 'NULL') OR coalesce(json_type({_any_case('m', 'type')}), 'NULL') NOT IN ('VARCHAR', 'NULL'))) ELSE FALSE END),
r_nodes AS (
  SELECT k, path, up, pos, lvl, coalesce(CASE WHEN json_type({type_}) = 'VARCHAR' THEN {type_} ->> '$' END, '') AS type,
    CASE WHEN json_type({attrs}) = 'OBJECT' THEN {attrs} ELSE CAST('{{}}' AS JSON) END AS a,
    CASE WHEN json_type({text}) = 'VARCHAR' THEN {text} ->> '$' END AS t,
    CASE WHEN json_type({marks}) = 'ARRAY' THEN list_sort(list_transform(list_filter(CAST({marks} AS JSON[]), lambda m: json_type(m) = 'OBJECT'), lambda m, n: {{'p': {_PRIORITY}, 'n': n, 'b': {_BEFORE}, 'z': {_AFTER}}})) ELSE [] END AS styles
  FROM r_flat WHERE k NOT IN (SELECT k FROM r_bad)),
r_html AS (
  SELECT DISTINCT t.k, t.path FROM r_nodes t JOIN r_nodes d ON d.k = t.k AND starts_with(d.path, t.path || '.')
  WHERE t.type = 'table' AND ((d.lvl >= t.lvl + 3 AND d.type IN {COMPLEX}) OR (d.lvl = t.lvl + 2 AND ({_int('colspan', 1).replace('(a,', '(d.a,')} > 1 OR {_int('rowspan', 1).replace('(a,', '(d.a,')} > 1)))),
r_known AS (
  SELECT n.*, h.path IS NOT NULL AS html, n.type IN ('extension','inlineExtension','bodiedExtension') AND coalesce({_attr('extensionKey').replace('(a,', '(n.a,')}, '') = 'jira' AS jira FROM r_nodes n LEFT JOIN r_html h ON h.k = n.k AND h.path = n.path),
r_seen(k, path, role, type, html, jira, up_html, up_type, deep, owner) AS (
  SELECT k, path, 'md', type, html, jira, FALSE, '', 0, NULL::VARCHAR FROM r_known WHERE lvl = 0
  UNION ALL
  SELECT n.k, n.path, {_ROLE}, n.type, n.html, n.jira, CASE WHEN u.role = 'md' AND u.type = 'table' THEN u.html ELSE FALSE END, u.type,
    CASE WHEN u.role = 'md' AND u.type IN {HTML_LISTS} THEN u.deep + 1 ELSE u.deep END,
    CASE WHEN u.role = 'md' AND u.type = 'orderedList' THEN u.path WHEN u.role = 'md' AND u.type IN {HTML_LISTS} THEN NULL ELSE u.owner END
  FROM r_seen u JOIN r_known n ON n.k = u.k AND n.up = u.path WHERE NOT {_STOPS}),
r_ready AS (
  SELECT s.*, n.up, n.pos, n.lvl, n.a, n.t, CASE WHEN s.type = 'tableHeader' THEN 'th' ELSE 'td' END AS tag,
    row_number() OVER (PARTITION BY s.k, s.owner, s.role = 'md' AND s.type = 'listItem' ORDER BY list_transform(string_split(s.path, '.')[2:], lambda x: CAST(x AS INTEGER))) AS nth,
    array_to_string(list_transform(list_reverse(styles), lambda x: x.b), '') || coalesce(t, '') || array_to_string(list_transform(styles, lambda x: x.z), '') AS marked,
    coalesce(TRY_CAST(nullif(regexp_extract({_attr('timestamp').replace('(a,', '(n.a,')}, '^[0-9]*'), '') AS BIGINT), 0) AS ms,
    coalesce(nullif({_param('key').replace('(a,', '(n.a,')}, ''), nullif({_param('issueKey').replace('(a,', '(n.a,')}, '')) AS ticket
  FROM r_seen s JOIN r_known n ON n.k = s.k AND n.path = s.path),
r_up(lvl, k, path, up, pos, o) AS (
  SELECT max(lvl) + 1, NULL::{{k}}, NULL::VARCHAR, NULL::VARCHAR, 0, NULL::VARCHAR FROM r_ready
  UNION ALL
  SELECT x.lvl, x.k, x.path, x.up, x.pos, {_OUTPUT} FROM (
    SELECT n.*, coalesce(g.c, '') AS c, {_settle("coalesce(g.c, '')")} AS i FROM r_ready n
    LEFT JOIN (SELECT k, up, string_agg(o, '' ORDER BY pos) AS c FROM r_up WHERE path IS NOT NULL GROUP BY k, up) g ON g.k = n.k AND g.up = n.path
    WHERE n.lvl = (SELECT max(lvl) - 1 FROM r_up)) x),
r_text AS (SELECT k, regexp_replace({_settle('o')}, '\\n{{{{3,}}}}', chr(10) || chr(10), 'g') AS m FROM r_up WHERE path = ''),
r_split AS (SELECT k, n, line, {strip('line')} AS bare FROM (SELECT k, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS n FROM r_text)),
r_fence AS (SELECT *, starts_with(bare, '```') AS fence, coalesce(count(*) FILTER (starts_with(bare, '```')) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM r_split),
r_kind AS (SELECT *, open AND NOT fence AS code, NOT fence AND left(bare, 1) = '|' AND right(bare, 1) = '|' AS row_, bare IN ('---', '***', '___') OR regexp_matches(bare, '^#{{{{1,6}}}} ') AS alone FROM r_fence),
r_state AS (SELECT *, coalesce(last_value(CASE WHEN bare <> '' AND NOT code THEN row_ END IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS tabled FROM r_kind),
r_parts AS (SELECT k, n, CASE WHEN code THEN line ELSE
  CASE WHEN (tabled AND bare <> '' AND NOT row_) OR (row_ AND NOT tabled) OR (alone AND NOT fence) THEN chr(2) || chr(10) ELSE '' END
  || CASE WHEN fence OR row_ THEN bare WHEN alone THEN bare || chr(10) || chr(2) WHEN bare <> '' THEN line ELSE chr(2) END END AS part FROM r_state),
rendered AS (SELECT k, replace(regexp_replace(regexp_replace(string_agg(part, chr(10) ORDER BY n), '\\x02(\\n\\x02)*', chr(2), 'g'), '^\\x02(\\n|$)', ''), chr(2), '') AS markdown FROM r_parts GROUP BY k)""".replace("{k}", "VARCHAR").replace("{{", "{").replace("}}", "}")


def with_title(markdown: str, title: str) -> str:
    first = f"trim(string_split(regexp_replace({markdown}, '^\\x{{feff}}', ''), chr(10))[1])"
    return f"CASE WHEN starts_with({first}, '# ') AND lower(trim(substr({first}, 3))) = lower(trim({title})) THEN {markdown} ELSE '# ' || {title} || chr(10) || chr(10) || {markdown} END"
