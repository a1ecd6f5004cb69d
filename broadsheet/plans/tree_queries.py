"""Tree-aware markup rules and the whole cleaning over whole pages; the markup they act on is injected into every article.

Each query's SQL is built from ``markup_sql``: the same tokens, element stacks by recursion, decisions by windows and
element intervals instead of folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import clean, markup, rules, tree
from broadsheet.operators import audit
from broadsheet.plans import markup_sql as m
from broadsheet.plans.catalog import _fill, q, query, suffix_sql, table

GRIN, FLAG = "\U0001f600", "\U0001f1e8\U0001f1f3"
TABLES = (
    '<table role="presentation"><tr><td>lay {id}</td><td>out</td></tr></table><table><tr><td>one {m}</td></tr><tr><th>col</th></tr></table>'
    '<table class="d"><tr><th>H1</th><th>H2</th></tr><tr><td colspan="2" bgcolor="red" style="color:red;width:10px;text-align: left">{id}</td><td>b</td></tr></table>'
    "<table><tbody><tr><td>x</td><td>y{m}</td></tr></tbody></table>"
    "<table><tr><td>a</td><td><table><tr><td>in{id}</td><td>ner</td></tr></table></td></tr></table>"
    '<table><tr><td>p</td><td>q<table role="none"><tr><td>only</td><td>layout</td></tr></table></td></tr></table>'
)
LINKS = (
    '<a href="b{m}.html">rel</a><a href="/r/{id} x">rooted <b>bold</b></a><a href="https://x.example.net/q w?a=1&amp;b=2">space</a><a href="javascript:void(0)">js{id}</a>'
    '<a href="">none</a><a href="#top">top</a><a name="k">anchor</a><a href="mailto:a@b.c">mail</a><a href=\'/single?x=1&amp;y={m}\'>single</a>'
    '<a href="/outer">outer <a href="/inner">inner</a> rest</a>'
)
ICONS = (
    '<a href="/w"><img src="/i{id}.png" width="16" alt="w">x</a><a href="/h"><img src="/j.png" height="032"></a><a href="/s"><img src="/k.png" style="max-width: 24px"></a>'
    '<a href="/big"><img src="/l{id}.png" width="33" height="640" style="height:20px"></a><a href="/two"><img src="/m.png" width="320"><img src="/n.png" width="{m}"></a>'
    '<img src="/free.png" width="8"><a href="/pct"><img src="/o.png" width="50%"></a>'
)
TAGS = (
    '<font face="Arial" size="5" color="red">font{id}</font><font color="blue">plain</font><font size="9">nine</font><row><cell align="left">c{m}</cell></row>'
    '<img src="/p{id}.png" width="{m}.7" height="abc" onload="x()" style="width:50%;color:blue" data-src="/lazy.png"><img src="/q.png" width=" 12 " height="-3.9">'
    '<h2 onclick="f()" id="h{id}" style="Margin:0; color : red;">head</h2><span lang="en" data-x="1" title="t">span</span>'
)
BLOCKS = (
    '<p class="c" style="color: red; text-align:center; margin:0">styled <div class="x">block{id}</div> tail <b>bold <h3>deep</h3> end</b><p>second<hr>after</p>'
    "<ul><li>x<li>y</ul><p>open <i>italic<blockquote>quote</p> more</blockquote></em> stray</div>"
)
GONE = (
    '<svg width="3"><path d="M0"/><g><text>t</text></g></svg><iframe src="x">frame</iframe><form action="/f"><input type="text"><button>go</button> in form</form>'
    '<video src="v.mp4"><source src="w.mp4">no video</video><noscript>none<p>deep</p></noscript><script>var t = "</p>{id}";</script>'
)
EMOJI = f'<p>emoji {GRIN}{GRIN} and <span class="emoji">{GRIN}</span> flag {FLAG} <span class="emoji"><i>{GRIN}</i></span></p><script>"{GRIN}"</script><img alt="{GRIN}" src="/e.png">'
NESTS = (
    '<div class="e"><section><p><b><i> </i></b></p>\n<span></span></section></div><div><p><b><i><u>kept {id}</u></i></b><em></em></p></div><div><br></div><table><tr><td></td></tr></table>'
    "<div><!-- note {m} --></div><p>&nbsp;</p><p><!-- c --><b></b>text<!-- d --></p><div><span>\t</span><script> </script></div><div><script>1</script></div><div><a><i></div>"
)
ALL = TABLES + LINKS + ICONS + TAGS + BLOCKS + GONE + EMOJI + NESTS


def injected(spark, sf: str, template: str) -> DataFrame:
    """pages with the markup at the end of the article."""
    p = table(spark, sf, "pages")
    return p.withColumn("html", F.replace("html", F.lit("</article>"), F.concat(_fill(template), F.lit("</article>"))))


def injected_sql(template: str) -> str:
    return f"SELECT page_id, url, replace(html, '</article>', {suffix_sql(template)} || '</article>') AS html FROM pages"


def _rebuilt(template: str, act: str = "'keep'", **how) -> str:
    s = m.Script()
    s.add("src", injected_sql(template))
    toks = m.keep_all(s, "a", m.tokens(s, "a", "src"), act)
    return s.query(f"SELECT page_id, html FROM {m.rebuild(s, 'b', toks, **how)}")


@query("x21_balance", _rebuilt(BLOCKS + LINKS, m.SHELL))
def x21(spark, sf):
    return injected(spark, sf, BLOCKS + LINKS).select("page_id", tree.balance(F.col("html")).alias("html"))


@query("x19_block_in_paragraph", _rebuilt(BLOCKS + NESTS, paragraphs=True))
def x19(spark, sf):
    return injected(spark, sf, BLOCKS + NESTS).select("page_id", tree.fix_nested_blocks(F.col("html")).alias("html"))


@query("x18_drop_subtrees", _rebuilt(GONE + TAGS, f"CASE WHEN name IN {m.names(fv.MEDIA_TAGS + fv.ACTIVE_TAGS)} THEN 'cut' ELSE 'keep' END"))
def x18(spark, sf):
    return injected(spark, sf, GONE + TAGS).select("page_id", tree.drop_elements(F.col("html"), fv.MEDIA_TAGS + fv.ACTIVE_TAGS).alias("html"))


@query("x23_wrap_emoji", _rebuilt(EMOJI, emoji=True))
def x23(spark, sf):
    return injected(spark, sf, EMOJI).select("page_id", tree.mark_emoji(F.col("html")).alias("html"))


def _x13_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(TABLES))
    toks = m.keep_all(s, "a", m.tokens(s, "a", "src"))
    toks = m.unwrapped(s, "u", toks, m.layout(s, "l", toks))
    return s.query(f"SELECT page_id, html FROM {m.rebuild(s, 'b', toks)}")


@query("x13_layout_tables", _x13_sql())
def x13(spark, sf):
    return injected(spark, sf, TABLES).select("page_id", tree.unwrap_layout_tables(F.col("html")).alias("html"))


def _x14_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(ICONS))
    toks = m.icons(s, "i", m.keep_all(s, "a", m.tokens(s, "a", "src")))
    return s.query(f"SELECT page_id, html FROM {m.rebuild(s, 'b', toks)}")


@query("x14_small_icons", _x14_sql())
def x14(spark, sf):
    return injected(spark, sf, ICONS).select("page_id", tree.drop_small_icons(F.col("html")).alias("html"))


def _x12_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(LINKS))
    return s.query(f"SELECT page_id, html FROM {m.rebuild(s, 'b', m.links(s, 'k', m.tokens(s, 'a', 'src')))}")


@query("x12_normalize_links", _x12_sql())
def x12(spark, sf):
    return injected(spark, sf, LINKS).select("page_id", tree.normalize_links(F.col("html"), F.col("url")).alias("html"))


def _x10_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(NESTS + BLOCKS))
    return s.query(f"SELECT page_id, html FROM {m.without_empty(s, 'a', 'src')}")


@query("x10_drop_empty", _x10_sql())
def x10(spark, sf):
    return injected(spark, sf, NESTS + BLOCKS).select("page_id", tree.drop_empty(F.col("html")).alias("html"))


# --- start and end rules --------------------------------------------------------------------------------------------
MARKED = '<div class="m"><p>before <i>Mark {id} & more</i> after, Mark {id} &amp; more again</p><p>spl<b>it</b> word</p></div><p>Mark {id} &amp; more <u>last</u></p>'
#: by page_id % 5: in the page's own text, escaped in the source, split over nodes, only in a script, nowhere
_FIRST_WORDS = "<h1>([^ <&]+ [^ <&]+)"


def _keyword():
    k = F.col("page_id") % 5
    own = F.regexp_extract("html", _FIRST_WORDS, 1)
    mark = F.concat(F.lit("Mark "), F.col("page_id").cast("string"), F.lit(" & more"))
    return F.when(k == 0, own).when(k == 1, mark).when(k == 2, "split word").when(k == 3, "track(").otherwise("no such text")


_KEYWORD_SQL = f"""CASE page_id % 5 WHEN 0 THEN regexp_extract(html, '{_FIRST_WORDS}', 1) WHEN 1 THEN 'Mark ' || page_id || ' & more' WHEN 2 THEN 'split word'
    WHEN 3 THEN 'track(' ELSE 'no such text' END"""


def _cut_sql(start: bool) -> str:
    s = m.Script()
    s.add("src", injected_sql(MARKED + BLOCKS))
    return s.query(f"SELECT page_id, html FROM {m.cut(s, 'a', 'src', _KEYWORD_SQL, start)}")


@query("x6_cut_start", _cut_sql(True))
def x6(spark, sf):
    return injected(spark, sf, MARKED + BLOCKS).select("page_id", rules.cut_start(F.col("html"), _keyword()).alias("html"))


@query("x7_cut_end", _cut_sql(False))
def x7(spark, sf):
    return injected(spark, sf, MARKED + BLOCKS).select("page_id", rules.cut_end(F.col("html"), _keyword()).alias("html"))


# --- the whole cleaning ---------------------------------------------------------------------------------------------
WHOLE = MARKED + ALL + "<p>x <i>End {id} of it</i> gone</p>"
_LEAD = "https://cdn.example.net/lead{id}.jpg?x=1&y=2"


def article_bodies(spark, sf: str) -> DataFrame:
    """Injected pages with images, link option and exclude rules that differ by page."""
    pid = F.col("page_id").cast("string")
    rule = lambda kind, value: F.struct(F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    some = (
        F.when(F.col("page_id") % 4 == 1, F.array(rule("start", F.concat(F.lit("Mark "), pid, F.lit(" & more")))))
        .when(F.col("page_id") % 4 == 2, F.array(rule("end", F.concat(F.lit("End "), pid, F.lit(" of"))), rule("exact", "<hr>")))
        .when(F.col("page_id") % 4 == 3, F.array(rule("tail", "x"), rule("exact", ""), rule("start", "no such text"), rule("exact", "styled ")))
    )
    lead = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("https://cdn.example.net/p"), pid, F.lit(".png")))).when(
        F.col("page_id") % 3 == 1, F.array(F.replace(F.lit(_LEAD), F.lit("{id}"), pid), F.lit("https://cdn.example.net/second.png"))
    )
    keep = F.when(F.col("page_id") % 5 == 3, "N").when(F.col("page_id") % 5 == 2, "Y")
    return injected(spark, sf, WHOLE).select("page_id", "url", "html", lead.alias("images"), keep.alias("keep_link"), some.alias("exclude"))


def cleaned(spark, sf: str) -> DataFrame:
    return clean.clean_bodies(article_bodies(spark, sf), "html", "url", "images", "keep_link", "exclude", "body").select("page_id", F.col("body").alias("html"))


def _clean_script() -> tuple[m.Script, str]:
    s = m.Script()
    s.add("src", injected_sql(WHOLE))
    written = f"replace({q(_LEAD.replace('&', '&amp;'))}, '{{id}}', CAST(page_id AS VARCHAR))"
    s.add("led", f"""SELECT page_id, url, CASE WHEN page_id % 3 = 1 THEN regexp_replace(html, '(<body[^>]*>)', '\\1<p><img src="' || {written} || '" alt="Lead Image"></p>') ELSE html END AS html FROM src""")
    cut = m.cut(s, "c", "led", "CASE page_id % 4 WHEN 1 THEN 'Mark ' || page_id || ' & more' WHEN 3 THEN 'no such text' ELSE '' END", True)
    cut = m.cut(s, "d", cut, "CASE page_id % 4 WHEN 2 THEN 'End ' || page_id || ' of' ELSE '' END", False)
    s.add("ruled", f"SELECT page_id, url, CASE page_id % 4 WHEN 2 THEN replace(html, '<hr>', '') WHEN 3 THEN replace(html, 'styled ', '') ELSE html END AS html FROM {cut}")
    s.add("with_rules", "SELECT * FROM ruled WHERE page_id % 4 <> 0")
    s.add("body", f"SELECT * FROM {m.without_empty(s, 'e', 'with_rules')} UNION ALL SELECT * FROM ruled WHERE page_id % 4 = 0")
    toks = m.links(s, "k", m.tokens(s, "a", "body"), "CASE page_id % 5 WHEN 3 THEN 'N' ELSE 'Y' END")
    toks = m.unwrapped(s, "u", toks, m.layout(s, "l", toks))
    toks = m.rewritten(s, "w", m.icons(s, "i", toks))
    return s, m.rebuild(s, "z", toks, paragraphs=True, emoji=True)


def _clean_sql() -> str:
    s, out = _clean_script()
    return s.query(f"SELECT page_id, html FROM {out}")


@query("x26_clean", _clean_sql())
def x26(spark, sf):
    return cleaned(spark, sf)


# --- audit ----------------------------------------------------------------------------------------------------------
def _audit_select(s: m.Script, p: str, source: str) -> str:
    """rule and n over the bodies of a relation (page_id, url, html)."""
    t = m.tokens(s, p, source)
    tag, img = "kind IN ('open', 'void')", "kind IN ('open', 'void') AND name = 'img'"
    an = "lower(regexp_extract(a, '^[^\\s=]+'))"
    href = m.strip(m.decode(m.attr("href")))
    fine = f"starts_with({href}, '#') OR regexp_matches({href}, '(?i)^(http|https|mailto|tel):') AND NOT contains({href}, ' ')"
    odd = " OR ".join(f"{m.has(w)} AND NOT regexp_matches({m.attr(w)}, '^-?[0-9]+$')" for w in ("width", "height"))
    s.add(f"{p}_g", f"""SELECT *, sum(CASE WHEN name = 'p' AND kind = 'open' THEN 1 WHEN name = 'p' AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS ps FROM {t}""")
    s.add(f"{p}_h", f"SELECT *, ps - least(0, min(ps) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM {p}_g")
    s.add(f"{p}_i", f"SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY pos), 0) AS inside FROM {p}_h")
    s.add(f"{p}_v", f"""SELECT page_id, count(*) FILTER (kind IN ('open', 'void', 'raw') AND name IN {m.names(fv.MEDIA_TAGS + fv.ACTIVE_TAGS)}) AS active_or_media_tag,
        count(*) FILTER ({tag} AND name IN {m.names(fv.TAG_RENAMES)}) AS legacy_tag,
        count(*) FILTER ({tag} AND len(list_filter(attrs, lambda a: {an} NOT IN {m.names(fv.ALLOWED_ATTRS)})) > 0) AS disallowed_attribute,
        count(*) FILTER ({img} AND ({odd})) AS fractional_size, count(*) FILTER (name = 'a' AND kind = 'open' AND {m.has('href')} AND NOT ({fine})) AS bad_href,
        count(*) FILTER ({tag} AND name IN {m.names(fv.BLOCK_TAGS)} AND inside > 0) AS block_in_paragraph,
        abs(count(*) FILTER (kind = 'open') - count(*) FILTER (kind = 'close')) AS unclosed_tag,
        count(*) FILTER ({img} AND regexp_matches({m.attr('src')}, '^(https?:)?//')) AS remote_image FROM {p}_i GROUP BY page_id""")
    bare = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"
    s.add(f"{p}_b", f"SELECT count(*) FILTER ({m.strip(m.decode(bare))} = '' AND NOT regexp_matches(html, '(?i)<img[\\s/>]')) AS n FROM {source}")
    each = [f"SELECT {q(r)} AS rule, CAST(coalesce(sum({r}), 0) AS BIGINT) AS n FROM {p}_v" for r in audit.RULES if r != "empty_body"]
    return " UNION ALL ".join([*each, f"SELECT 'empty_body', n FROM {p}_b"])


def _audit_sql() -> str:
    s = m.Script()
    s.add("src", injected_sql(WHOLE))
    return s.query(_audit_select(s, "q", "src"))


def _audit_clean_sql() -> str:
    s, out = _clean_script()
    s.add("done", f"SELECT page_id, '' AS url, html FROM {out}")
    return s.query(_audit_select(s, "q", "done"))


@query("x27_audit", _audit_sql())
def x27(spark, sf):
    return audit.violations(injected(spark, sf, WHOLE), "html")


@query("x27_audit_clean", _audit_clean_sql())
def x27_clean(spark, sf):
    return audit.violations(cleaned(spark, sf), "html")


# --- rules on one tag, over every tag of the page -------------------------------------------------------------------
def _tags_sql(out: str, template: str) -> str:
    """Pages with every opening tag written anew by an SQL expression over the token."""
    s = m.Script()
    s.add("src", injected_sql(template))
    t = m.tokens(s, "a", "src")
    return s.query(f"SELECT page_id, string_agg(CASE WHEN kind IN ('open', 'void') THEN {out} ELSE raw END, '' ORDER BY pos) AS html FROM {t} GROUP BY page_id")


def _tags(spark, sf: str, template: str, rewrite) -> DataFrame:
    tag = lambda t: F.when(markup.is_tag(t) & ~t.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>\z"), rewrite(t, markup.name_of(t))).otherwise(t)
    return injected(spark, sf, template).select("page_id", markup.map_tokens(F.col("html"), tag).alias("html"))


_END = "CASE WHEN ends_with(raw, '/>') THEN '/>' ELSE '>' END"
_AN = "lower(regexp_extract(a, '^[^\\s=]+'))"


def _joined(attrs: str, name: str = "regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9:_-]*)', 1)") -> str:
    return f"'<' || {name} || coalesce(array_to_string(list_transform({attrs}, lambda a: ' ' || a), ''), '') || {_END}"


_KEPT = f"list_filter(attrs, lambda a: {_AN} IN {m.names(fv.ALLOWED_ATTRS)} AND ({_AN} NOT IN ('width', 'height') OR name = 'img'))"


@query("x20_filter_attrs", _tags_sql(_joined(_KEPT), TAGS + TABLES))
def x20(spark, sf):
    return _tags(spark, sf, TAGS + TABLES, markup.filter_attrs)


_NEW_STYLE = m.style_value(m.attr("style"), "name = 'img'")
_STYLED = f"""list_transform(list_filter(attrs, lambda a: NOT ({_AN} = 'style' AND ({_NEW_STYLE}) = '')),
    lambda a: CASE WHEN {_AN} = 'style' THEN regexp_extract(a, '^[^=]*=') || '"' || ({_NEW_STYLE}) || '"' ELSE a END)"""


@query("x16_filter_styles", _tags_sql(_joined(_STYLED), TAGS + TABLES + BLOCKS))
def x16(spark, sf):
    return _tags(spark, sf, TAGS + TABLES + BLOCKS, markup.filter_style)


def _whole(which: str) -> str:
    return f"CAST(trunc(try_cast({m.strip(m.attr(which))} AS DOUBLE)) AS BIGINT)"


_SIZED = f"""list_transform(list_filter(attrs, lambda a: name <> 'img' OR NOT ({_AN} = 'width' AND {_whole('width')} IS NULL OR {_AN} = 'height' AND {_whole('height')} IS NULL)),
    lambda a: CASE WHEN name = 'img' AND {_AN} IN ('width', 'height') THEN {_AN} || '="' || CASE {_AN} WHEN 'width' THEN {_whole('width')} ELSE {_whole('height')} END || '"' ELSE a END)"""


@query("x17_int_dimensions", _tags_sql(_joined(_SIZED), TAGS + ICONS))
def x17(spark, sf):
    return _tags(spark, sf, TAGS + ICONS, markup.int_dimensions)


_PX = "CASE " + m.attr("size") + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.FONT_SIZE_PX.items()) + f" ELSE {q(fv.FONT_SIZE_DEFAULT_PX)} END"
_FONT = f"""array_to_string(list_filter([CASE WHEN {m.attr('face')} <> '' THEN 'font-family:' || {m.attr('face')} END, CASE WHEN {m.attr('size')} <> '' THEN 'font-size:' || {_PX} || 'px' END],
    lambda x: x IS NOT NULL), ';')"""
_RENAMED = f"""CASE name WHEN 'font' THEN '<span' || coalesce(array_to_string(list_transform(list_filter(attrs, lambda a: {_AN} NOT IN ('color', 'face', 'size')), lambda a: ' ' || a), ''), '')
    || CASE WHEN {_FONT} = '' THEN '' ELSE ' style="' || {_FONT} || '"' END || '>' WHEN 'row' THEN {_joined('attrs', "'tr'")} WHEN 'cell' THEN {_joined('attrs', "'td'")} ELSE raw END"""


@query("x15_rename_tags", _tags_sql(_RENAMED, TAGS))
def x15(spark, sf):
    return _tags(spark, sf, TAGS, markup.rename_tag)
