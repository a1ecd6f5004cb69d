"""DuckDB SQL for tree-aware markup rules: tokens by pattern, element stacks by recursion, decisions by windows and intervals.

Each function adds named relations to a ``Script``.  Page relations have (page_id, url, html); token relations have
(page_id, url, pos, raw, name, kind, attrs).
"""

from __future__ import annotations

from broadsheet import fixed_values as fv
from broadsheet.plans.catalog import q

_ATTR = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
NO_TEXTS, NO_INTS = "CAST([] AS VARCHAR[])", "CAST([] AS INT[])"
SPACE = f"[{fv.SPACE_CLASS}]"
PARTS = [*fv.TABLE_PART_TAGS]


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


class Script:
    """Named relations, each built on earlier ones."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def walk(self, name: str, columns: str, start: str, step: str) -> str:
        self.parts.append(f"{name}({columns}) AS ({start} UNION ALL {step})")
        return name

    def query(self, select: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + select


def attr(name: str) -> str:
    """Value of an attribute of the token, '' when absent."""
    found = f"list_filter(attrs, lambda a: lower(regexp_extract(a, '^[^\\s=]+')) = {q(name)})[1]"
    return f"""coalesce(regexp_replace(regexp_extract({found}, '(?s)^[^\\s=]+\\s*=\\s*(.*)$', 1), '^["'']|["'']$', '', 'g'), '')"""


def has(name: str) -> str:
    return f"len(list_filter(attrs, lambda a: lower(regexp_extract(a, '^[^\\s=]+')) = {q(name)})) > 0"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def decode(x: str) -> str:
    for entity, char in fv.HTML_ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def tokens(s: Script, p: str, source: str) -> str:
    """Tokens of a page relation."""
    s.add(f"{p}_r", f"SELECT page_id, url, regexp_extract_all(html, {q(fv.TOKEN)}) AS ts FROM {source}")
    s.add(f"{p}_u", f"SELECT page_id, url, unnest(ts) AS raw, generate_subscripts(ts, 1) AS pos FROM {p}_r")
    s.add(f"{p}_n", f"SELECT *, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) AS name FROM {p}_u")
    kind = f"""CASE WHEN NOT starts_with(raw, '<') OR raw = '<' THEN 'text' WHEN starts_with(raw, '<!') OR starts_with(raw, '<?') THEN 'comment'
        WHEN starts_with(raw, '</') THEN 'close' WHEN name IN ('script', 'style') AND regexp_matches(raw, '(?i)</(script|style)\\s*>$') THEN 'raw'
        WHEN name IN {names(fv.VOID_TAGS)} OR ends_with(raw, '/>') THEN 'void' ELSE 'open' END"""
    s.add(f"{p}_k", f"SELECT *, {kind} AS kind FROM {p}_n")
    body = "regexp_replace(raw, '^<[a-zA-Z][^\\s/>]*|\\s*/?>$', '', 'g')"
    return s.add(f"{p}_t", f"SELECT *, CASE WHEN kind IN ('open', 'void') THEN regexp_extract_all({body}, {q(_ATTR)}) ELSE {NO_TEXTS} END AS attrs FROM {p}_k")


_LAST = "CASE WHEN list_contains(names, t.name) THEN len(names) - list_position(list_reverse(names), t.name) + 1 ELSE 0 END"


def stacks(s: Script, p: str, toks: str) -> str:
    """Per token the open elements before it (names, positions) and the positions of those that it closes."""
    step = f"""SELECT page_id, pos, CASE WHEN kind = 'open' THEN list_append(names, name) WHEN k > 0 THEN names[1 : k - 1] ELSE names END,
          CASE WHEN kind = 'open' THEN list_append(opened, pos) WHEN k > 0 THEN opened[1 : k - 1] ELSE opened END,
          opened, CASE WHEN k > 0 THEN opened[k : len(opened)] ELSE {NO_INTS} END
        FROM (SELECT t.page_id, CAST(t.pos AS INT) AS pos, t.kind, t.name, w.names, w.opened, CASE WHEN t.kind = 'close' THEN {_LAST} ELSE 0 END AS k
              FROM {p}_w w JOIN {toks} t ON t.page_id = w.page_id AND t.pos = w.pos + 1)"""
    start = f"SELECT page_id, 0, {NO_TEXTS}, {NO_INTS}, {NO_INTS}, {NO_INTS} FROM (SELECT DISTINCT page_id FROM {toks})"
    return s.walk(f"{p}_w", "page_id, pos, names, opened, before, closed", start, step)


def rebuild(s: Script, p: str, toks: str, paragraphs: bool = False, emoji: bool = False) -> str:
    """Well-nested markup of tokens with (act, out): (page_id, html)."""
    inside = f"(t.kind IN ('open', 'void') AND t.name IN {names(fv.BLOCK_TAGS)} AND cut = 0 AND t.act = 'keep' AND list_contains(names, 'p'))" if paragraphs else "false"
    text = f"CASE WHEN kind = 'text' AND NOT marked THEN regexp_replace(out, {q('(' + fv.EMOJI + ')')}, '<span class=\"emoji\">\\1</span>', 'g') ELSE out END" if emoji else "out"
    renamed = "CASE name " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.TAG_RENAMES.items()) + " ELSE name END"
    step = f"""SELECT page_id, pos, CASE WHEN kind = 'open' THEN list_append(bn, name) ELSE bn END,
          CASE WHEN kind = 'open' THEN list_append(be, CASE WHEN left_cut = 0 AND act = 'keep' THEN '</' || {renamed} || '>' ELSE '' END) ELSE be END,
          CASE WHEN kind = 'open' AND left_cut = 0 AND act = 'cut' THEN len(bn) + 1 ELSE left_cut END,
          CASE WHEN kind = 'open' THEN raw = '<span class="emoji">' WHEN kind = 'close' OR k > 0 THEN false ELSE marked END,
          closing || CASE WHEN kind = 'close' OR left_cut > 0 OR act <> 'keep' THEN '' WHEN kind = 'open' THEN out ELSE {text} END
        FROM (SELECT *, CASE WHEN k > 0 THEN names[1 : k - 1] ELSE names END AS bn, CASE WHEN k > 0 THEN ends[1 : k - 1] ELSE ends END AS be,
                CASE WHEN k > 0 THEN array_to_string(list_reverse(ends[k : len(ends)]), '') ELSE '' END AS closing, CASE WHEN k > 0 AND cut >= k THEN 0 ELSE cut END AS left_cut
              FROM (SELECT t.page_id, CAST(t.pos AS INT) AS pos, t.raw, t.kind, t.name, t.act, t.out, w.names, w.ends, w.cut, w.marked,
                      CASE WHEN {inside} THEN list_position(names, 'p') WHEN t.kind = 'close' OR t.kind = 'open' AND t.name = 'a' THEN {_LAST} ELSE 0 END AS k
                    FROM {p}_w w JOIN {toks} t ON t.page_id = w.page_id AND t.pos = w.pos + 1))"""
    start = f"SELECT page_id, 0, {NO_TEXTS}, {NO_TEXTS}, 0, false, '' FROM (SELECT DISTINCT page_id FROM {toks})"
    s.walk(f"{p}_w", "page_id, pos, names, ends, cut, marked, emitted", start, step)
    return s.add(f"{p}_o", f"SELECT page_id, string_agg(emitted, '' ORDER BY pos) || array_to_string(list_reverse(arg_max(ends, pos)), '') AS html FROM {p}_w GROUP BY page_id")


# --- decisions ------------------------------------------------------------------------------------------------------
SHELL = "CASE WHEN name IN ('html', 'body') THEN 'unwrap' WHEN name = 'head' OR kind = 'comment' AND regexp_matches(raw, '(?i)^<(!doctype|\\?)') THEN 'cut' ELSE 'keep' END"


def layout(s: Script, p: str, toks: str) -> str:
    """(page_id, first, last) of layout tables, from element intervals; tables in the text must be well nested."""
    s.add(f"{p}_p", f"""SELECT page_id, pos, name, kind, {attr('role')} AS role,
        sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) + CASE kind WHEN 'open' THEN 0 ELSE 1 END AS level
        FROM {toks} WHERE name IN {names(['table', *PARTS])} AND kind IN ('open', 'close')""")
    s.add(f"{p}_e", f"SELECT * FROM (SELECT *, lead(pos) OVER (PARTITION BY page_id, level ORDER BY pos) AS last FROM {p}_p) WHERE kind = 'open'")
    s.add(f"{p}_f", f"""SELECT c.page_id, c.pos, any_value(c.name) AS name, arg_max(o.name, o.pos) AS parent, max(o.pos) AS parent_pos
        FROM {p}_e c JOIN {p}_e o ON o.page_id = c.page_id AND o.pos < c.pos AND c.pos < o.last GROUP BY c.page_id, c.pos""")
    s.add(f"{p}_c", f"""SELECT r.page_id, r.parent_pos AS pos, max(n) AS n FROM {p}_f r
        JOIN (SELECT page_id, parent_pos, count(*) AS n FROM {p}_f WHERE name IN ('td', 'th') AND parent = 'tr' GROUP BY ALL) c ON c.page_id = r.page_id AND c.parent_pos = r.pos
        WHERE r.name = 'tr' AND r.parent = 'table' GROUP BY r.page_id, r.parent_pos""")
    s.add(f"{p}_d", f"""SELECT t.page_id, t.pos, t.last, t.role NOT IN ('presentation', 'none') AND coalesce(c.n, 0) > 1 AS data
        FROM {p}_e t LEFT JOIN {p}_c c USING (page_id, pos) WHERE t.name = 'table'""")
    return s.add(f"{p}_l", f"""SELECT page_id, pos AS first, last FROM {p}_d t WHERE NOT data
        OR EXISTS (SELECT 1 FROM {p}_d i WHERE i.page_id = t.page_id AND t.pos < i.pos AND i.pos < t.last AND i.data)""")


def unwrapped(s: Script, p: str, toks: str, spans: str) -> str:
    """Tokens with (act, out), layout tables and the table parts inside them unwrapped."""
    hit = f"""EXISTS (SELECT 1 FROM {spans} l WHERE l.page_id = t.page_id AND (t.name = 'table' AND t.pos = l.first OR t.name IN {names(PARTS)} AND l.first < t.pos AND t.pos < l.last))"""
    return s.add(f"{p}_a", f"SELECT t.* REPLACE (CASE WHEN {hit} THEN 'unwrap' ELSE act END AS act) FROM {toks} t")


def icons(s: Script, p: str, toks: str) -> str:
    """Tokens whose link holds a small image are set to be cut."""
    small = f"try_cast({{}} AS INT) <= {fv.SMALL_ICON_PX}"
    tiny = " OR ".join(f"regexp_matches({attr(w)}, '^[0-9]+$') AND {small.format(attr(w))}" for w in ("width", "height"))
    style = f"lower({attr('style')})"
    pixels = f"len(list_filter(regexp_extract_all({style}, '([0-9]+)px', 1), lambda n: {small.format('n')})) > 0"
    s.add(f"{p}_i", f"""SELECT page_id, link FROM (SELECT *, max(CASE WHEN name = 'a' THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS link
        FROM {toks} WHERE name IN ('a', 'img') AND act = 'keep') WHERE name = 'img' AND ({tiny} OR contains({style}, 'width') AND {pixels})""")
    return s.add(f"{p}_a", f"SELECT t.* REPLACE (CASE WHEN kind = 'open' AND EXISTS (SELECT 1 FROM {p}_i i WHERE i.page_id = t.page_id AND i.link = t.pos) THEN 'cut' ELSE act END AS act) FROM {toks} t")


ROOT = "regexp_extract(url, '^[^/]*//[^/?#]*', 0)"
FOLDER = "regexp_extract(url, '^([^/]*//[^/?#]*/(?:[^?#]*/)?)', 1)"


def links(s: Script, p: str, toks: str, keep: str = "'Y'") -> str:
    """Tokens with (act, out) of the link rules; addresses are absolute, rooted, in the page's folder, or '#'."""
    s.add(f"{p}_h", f"SELECT t.*, {strip(decode(attr('href')))} AS href, {keep} AS keep_link FROM {toks} t")
    target = f"""CASE WHEN starts_with(href, '#') OR regexp_matches(href, '^https?:[^ ]*$') THEN href WHEN href = '' THEN NULL
        WHEN regexp_matches(href, '(?i)^(https?|mailto|tel):') THEN replace(href, ' ', '%20') WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN starts_with(href, '/') THEN replace({ROOT} || href, ' ', '%20') ELSE replace({FOLDER} || href, ' ', '%20') END"""
    s.add(f"{p}_g", f"SELECT *, {target} AS target FROM {p}_h")
    is_link = f"name = 'a' AND kind = 'open' AND {has('href')}"
    written = "replace(replace(target, '&', '&amp;'), '\"', '&quot;')"
    out = f"""CASE WHEN {is_link} AND target IS NOT NULL AND target <> href
        THEN regexp_replace(raw, '(?i)(\\shref\\s*=\\s*)("[^"]*"|''[^'']*''|[^\\s"''>]+)', '\\1"' || replace({written}, '\\', '\\\\') || '"') ELSE raw END"""
    return s.add(f"{p}_a", f"SELECT * EXCLUDE (href, target, keep_link), CASE WHEN name = 'a' AND keep_link = 'N' OR {is_link} AND target IS NULL THEN 'unwrap' ELSE 'keep' END AS act, {out} AS out FROM {p}_g")


def style_value(value: str, image: str) -> str:
    plain = f"regexp_replace({value}, {q(fv.COLOR_STYLE)}, '', 'g')"
    before = q("^([^:]*):")

    def prop(x: str) -> str:
        return f"lower({strip(f'regexp_extract({x}, {before}, 1)')})"

    rest = lambda x: strip(f"regexp_extract({x}, '(?s)^[^:]*:(.*)', 1)")
    kept = f"list_filter(string_split({plain}, ';'), lambda x: contains(x, ':') AND {prop('x')} NOT IN {names(fv.LAYOUT_PROPERTIES)} AND NOT contains({prop('x')}, 'background'))"
    other = f"array_to_string(list_transform({kept}, lambda x: {prop('x')} || ':' || {rest('x')}), ';')"
    return f"regexp_replace({strip(f'CASE WHEN {image} THEN {plain} ELSE {other} END')}, '^;+|;+$', '', 'g')"


def rewritten(s: Script, p: str, toks: str) -> str:
    """Tokens with all rewrites of their tags: renames, font, style, whole sizes, allowed attributes; active and media elements cut."""
    gone = f"name IN {names(fv.MEDIA_TAGS + fv.ACTIVE_TAGS + ['head'])}"
    act = f"CASE WHEN kind IN ('text', 'close') THEN act WHEN {gone} OR kind = 'comment' AND regexp_matches(raw, '(?i)^<(!doctype|\\?)') THEN 'cut' WHEN name IN ('html', 'body') THEN 'unwrap' ELSE act END"
    sizes = "CASE " + attr("size") + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.FONT_SIZE_PX.items()) + f" ELSE {q(fv.FONT_SIZE_DEFAULT_PX)} END"
    font = f"""array_to_string(list_filter([CASE WHEN {attr('face')} <> '' THEN 'font-family:' || {attr('face')} END, CASE WHEN {attr('size')} <> '' THEN 'font-size:' || {sizes} || 'px' END],
        lambda x: x IS NOT NULL), ';')"""
    # attributes of the tag as it is on output so far (links may have changed it)
    s.add(f"{p}_x", f"""SELECT * REPLACE ({act} AS act, CASE WHEN kind IN ('open', 'void') THEN regexp_extract_all(regexp_replace(out, '^<[a-zA-Z][^\\s/>]*|\\s*/?>$', '', 'g'), {q(_ATTR)}) ELSE attrs END AS attrs),
        CASE WHEN name = 'font' THEN {font} ELSE '' END AS font FROM {toks}""")
    s.add(f"{p}_y", f"""SELECT * REPLACE (CASE WHEN name <> 'font' THEN attrs ELSE
        list_concat(list_filter(attrs, lambda a: lower(regexp_extract(a, '^[^\\s=]+')) NOT IN ('color', 'face', 'size')), CASE WHEN font = '' THEN {NO_TEXTS} ELSE ['style="' || font || '"'] END) END AS attrs) FROM {p}_x""")
    s.add(f"{p}_v", f"SELECT *, {attr('style')} AS st, {style_value(attr('style'), "name = 'img'")} AS st_new FROM {p}_y")

    def number(which: str) -> str:
        return f"CAST(trunc(try_cast({strip(attr(which))} AS DOUBLE)) AS BIGINT)"

    an = "lower(regexp_extract(a, '^[^\\s=]+'))"
    s.add(f"{p}_z", f"SELECT *, {number('width')} AS w_new, {number('height')} AS h_new FROM {p}_v")
    attrs = f"""list_transform(list_filter(attrs, lambda a: {an} IN {names(fv.ALLOWED_ATTRS)} AND ({an} NOT IN ('width', 'height') OR name = 'img')
            AND NOT ({an} = 'style' AND st_new = '') AND NOT ({an} = 'width' AND w_new IS NULL) AND NOT ({an} = 'height' AND h_new IS NULL)),
        lambda a: CASE WHEN {an} = 'style' THEN regexp_extract(a, '^[^=]*=') || '"' || st_new || '"' WHEN {an} = 'width' THEN regexp_extract(a, '^[^=]*=') || '"' || w_new || '"'
            WHEN {an} = 'height' THEN regexp_extract(a, '^[^=]*=') || '"' || h_new || '"' ELSE a END)"""
    renamed = "CASE name " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fv.TAG_RENAMES.items()) + " ELSE name END"
    tag = f"""'<' || {renamed} || coalesce(array_to_string(list_transform({attrs}, lambda a: ' ' || a), ''), '') || CASE WHEN ends_with(raw, '/>') THEN '/>' ELSE '>' END"""
    return s.add(f"{p}_a", f"SELECT page_id, url, pos, raw, name, kind, act, CASE WHEN kind IN ('open', 'void') AND act = 'keep' THEN {tag} ELSE out END AS out FROM {p}_z")


def keep_all(s: Script, p: str, toks: str, act: str = "'keep'") -> str:
    return s.add(f"{p}_q", f"SELECT *, {act} AS act, raw AS out FROM {toks}")


# --- rules that cut -------------------------------------------------------------------------------------------------
def cut(s: Script, p: str, source: str, keyword: str, start: bool) -> str:
    """Pages cut through the first text token with the keyword, or from the last one; ``keyword`` is an expression over the page."""
    s.add(f"{p}_s", f"SELECT *, replace(replace(replace({keyword}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc, {keyword} AS plain FROM {source}")
    s.add(f"{p}_m", f"SELECT page_id, url, html, CASE WHEN contains(html, esc) THEN esc ELSE plain END AS kw FROM {p}_s")
    t = tokens(s, p, f"{p}_m")
    w = stacks(s, p, t)
    pick = "min" if start else "max"
    s.add(f"{p}_j", f"SELECT t.page_id, {pick}(pos) AS hit FROM {t} t JOIN {p}_m USING (page_id) WHERE kind = 'text' AND kw <> '' AND contains(raw, kw) GROUP BY ALL")
    s.add(f"{p}_b", f"SELECT j.page_id, unnest(w.before) AS pos FROM {p}_j j JOIN {w} w ON w.page_id = j.page_id AND w.pos = j.hit")
    if start:
        text = "substr(raw, instr(raw, kw) + length(kw))"
        pieces = f"""SELECT page_id, pos, raw AS piece FROM {p}_b JOIN {t} USING (page_id, pos)
            UNION ALL SELECT t.page_id, pos, CASE WHEN pos = hit THEN {text} ELSE raw END FROM {t} t JOIN {p}_j USING (page_id) JOIN {p}_m USING (page_id) WHERE pos >= hit"""
    else:
        text = "left(raw, length(raw) - instr(reverse(raw), reverse(kw)) + 1 - length(kw))"
        pieces = f"""SELECT t.page_id, pos, CASE WHEN pos = hit THEN {text} ELSE raw END AS piece FROM {t} t JOIN {p}_j USING (page_id) JOIN {p}_m USING (page_id) WHERE pos <= hit
            UNION ALL SELECT page_id, 1000000000 - pos, '</' || name || '>' FROM {p}_b JOIN {t} USING (page_id, pos)"""
    s.add(f"{p}_h", f"SELECT page_id, string_agg(piece, '' ORDER BY pos) AS html FROM ({pieces}) GROUP BY page_id")
    return s.add(f"{p}_o", f"SELECT m.page_id, m.url, coalesce(h.html, CASE WHEN j.hit IS NULL THEN m.html ELSE '' END) AS html FROM {p}_m m LEFT JOIN {p}_h h USING (page_id) LEFT JOIN {p}_j j USING (page_id)")


def without_empty(s: Script, p: str, source: str) -> str:
    """Pages without the elements that hold neither text nor a kept tag."""
    t = tokens(s, p, source)
    w = stacks(s, p, t)
    fixed = names([*fv.KEPT_WHEN_EMPTY, "html", "body", "head"])
    blank = f"regexp_replace(replace(replace(raw, '&nbsp;', ' '), '&#160;', ' '), {q(SPACE + '+')}, '', 'g') = ''"
    solid = f"""CASE kind WHEN 'text' THEN NOT ({blank}) WHEN 'raw' THEN NOT regexp_matches(raw, {q('(?is)^<[^>]*>' + SPACE + '*</')}) WHEN 'open' THEN name IN {fixed} WHEN 'void' THEN name IN {fixed} ELSE false END"""
    s.add(f"{p}_q", f"SELECT t.*, {solid} AS solid, before[-1] AS inner_pos, closed FROM {t} t JOIN {w} w USING (page_id, pos)")
    s.add(f"{p}_c", f"SELECT page_id, unnest(closed) AS pos, pos AS last FROM {p}_q")
    s.add(f"{p}_e", f"SELECT q.page_id, q.pos, q.name, coalesce(c.last, 1000000000) AS last FROM {p}_q q LEFT JOIN {p}_c c USING (page_id, pos) WHERE kind = 'open'")
    s.add(f"{p}_f", f"""SELECT e.* FROM {p}_e e WHERE e.name IN {fixed} OR EXISTS (SELECT 1 FROM {p}_q q WHERE q.page_id = e.page_id AND q.solid AND e.pos < q.pos AND q.pos < e.last)""")
    flow = f"""kind = 'text' OR kind = 'comment' OR solid"""
    s.add(f"{p}_h", f"""SELECT page_id, string_agg(piece, '' ORDER BY pos, nth) AS html FROM (
        SELECT q.page_id, q.pos, 1000000000 AS nth, raw AS piece FROM {p}_q q JOIN {p}_f f USING (page_id, pos)
        UNION ALL SELECT page_id, last, -pos, '</' || name || '>' FROM {p}_f
        UNION ALL SELECT q.page_id, q.pos, 0, raw FROM {p}_q q WHERE kind <> 'open' AND ({flow})
            AND (q.solid OR inner_pos IS NULL OR EXISTS (SELECT 1 FROM {p}_f f WHERE f.page_id = q.page_id AND f.pos = inner_pos))) GROUP BY page_id""")
    return s.add(f"{p}_o", f"SELECT s.page_id, s.url, coalesce(h.html, '') AS html FROM {source} s LEFT JOIN {p}_h h USING (page_id)")
