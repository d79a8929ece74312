"""URL filter with redirect equivalence.

Host and path rules judge a url first. Urls joined by redirects or canonical links form classes (distributed connected
components); a class with a blocked member is blocked, but for members that a rule allows by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

#: Fixed values: (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Tags that may hold a link, and entities that are read as their characters ('&amp;' last, so that nothing is decoded twice).
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]
#: The parts of a url: scheme and host, path, query.
ORIGIN, PATH, QUERY = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or without '://': both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of rules equally long, allow first. A short list of rules: plain conditions."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def attribute(tag, name: str) -> Column:
    """An attribute's value, in double, single or no quotes; '' if the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def without_dots(path: Column) -> Column:
    """A path without '.' and '..' segments."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def same_url(url: Column) -> Column:
    """One form for the ways to write a url: scheme and host in lower case, '/' for no path, no dot segments, no fragment. Without '://' as it is."""
    path = F.regexp_extract(url, PATH, 1)
    path = F.when(path == "", "/").when(path.contains("/."), without_dots(path)).otherwise(path)
    return F.when(F.instr(url, "://") > 0, F.concat(lower_ascii(F.regexp_extract(url, ORIGIN, 1)), path, F.regexp_extract(url, QUERY, 1))).otherwise(url)


def resolved(target: Column, page: Column) -> Column:
    """A link's target as a url, by its page's; null for other schemes and for links to the page itself."""
    origin, path = F.regexp_extract(page, ORIGIN, 1), F.regexp_extract(page, PATH, 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), target))
        .when(target.rlike(SCHEME), F.when(target.rlike(SCHEME + "//"), target))
        .when(F.instr(page, "://") == 0, F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, folder, target))
    )


def links_in(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of all canonical links and refreshes in html, whatever the order and quotes of attributes; targets are resolved against their page's url."""
    low = F.lower(F.col("html"))
    likely = pages.where((low.contains("canonical") | low.contains("refresh")) & F.col("url").isNotNull())
    tags = F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<link\s") & attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: attribute(t, "href"))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\s") & attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")), lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"']*)""", 1))
    found = likely.select(F.col("url").alias("src"), F.explode(F.concat(canonical, refresh)).alias("_t"))
    for entity, plain in ENTITIES:
        found = found.withColumn("_t", F.replace("_t", F.lit(entity), F.lit(plain)))
    return found.select("src", resolved(F.regexp_replace("_t", r"^\s+|\s+$", ""), F.col("src")).alias("dst")).where("dst is not null")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, class_url for every row.

    links: (src, dst) urls of redirects and canonical links, or None to read them from html. Urls that `same_url` writes alike are one. class_url is the
    smallest url of the class in that form (the url as it is when nothing links it, null for a null url). A link to a url that is no page still
    joins classes, and the rules judge it too. Pages that no rule fits take block from their class, else `default`.
    Repeated rows give repeated rows; a null or empty url has no links.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"), same_url(F.col("url")).alias("_key")).withColumn("rule", rule).withColumn("_own", verdict)
    links = links_in(pages) if links is None else links.select("src", "dst").where("src is not null and dst is not null")
    edges = materialize(links.select(same_url(F.col("src")).alias("src"), same_url(F.col("dst")).alias("dst")).where("src <> dst").distinct())
    classes = connected_components(edges)
    h, p = host_and_path(F.col("node"))
    of_node = rule_of(F.col("_h"), F.col("_p"), rules)[1]
    nodes = classes.withColumn("_h", h).withColumn("_p", p).withColumn("_v", of_node)
    blocked = nodes.groupBy("root").agg(F.max((F.col("_v") == "block").cast("int")).alias("_block"))
    by_url = nodes.join(blocked, "root").select(F.col("node").alias("_key"), F.col("root").alias("class_url"), "_block")
    out = judged.join(by_url, "_key", "left")
    said = F.coalesce("_own", F.when(F.col("_block") == 1, "block"), F.lit(default))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), F.coalesce("class_url", "url").alias("class_url"))


def op7(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def oracle() -> str:
    """The same in DuckDB SQL; classes by a recursive walk."""
    q = lambda s: s.replace("'", "''")
    part = lambda url, pattern: f"regexp_extract({url}, '{q(pattern)}', 1)"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    attr = lambda tag, name: "(" + " || ".join(f"regexp_extract({tag}, '" + q(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""") + f"', {k})" for k in (1, 2, 3)) + ")"
    case = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if what == 'v' else h + p}'"
        for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r), reverse=True)
    ) + " END"
    plain = "t"
    for entity, char in ENTITIES:
        plain = f"replace({plain}, '{q(entity)}', '{q(char)}')"

    def key(u):
        path, segments = part(u, PATH), f"string_split({part(u, PATH)}, '/')"
        kept = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({segments}[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a) - 1] WHEN x[1] = '.' THEN a ELSE a || x END)"
        dots = f"('/' || coalesce(array_to_string({kept}, '/'), '') || CASE WHEN {segments}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END)"
        path = f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {dots} ELSE {path} END"
        return f"CASE WHEN instr({u}, '://') > 0 THEN {low(part(u, ORIGIN))} || {path} || {part(u, QUERY)} ELSE {u} END"

    return rf"""
WITH RECURSIVE tags AS (SELECT url AS src, unnest(regexp_extract_all(html, '{q(TAGS)}', 0)) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
found AS (SELECT src, {attr("tag", "href")} AS t FROM tags WHERE regexp_matches(tag, '(?i)^<link\s') AND regexp_matches({attr("tag", "rel")}, '(?i)(^|\s)canonical(\s|$)')
  UNION ALL SELECT src, regexp_extract({attr("tag", "content")}, '(?is)\burl\s*=\s*["'']?\s*([^"'']*)', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta\s') AND regexp_matches({attr("tag", "http-equiv")}, '(?i)^\s*refresh\s*$')),
targets AS (SELECT src, regexp_replace({plain}, '^\s+|\s+$', '', 'g') AS t FROM found),
ends AS (SELECT src, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN starts_with(t, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || t
    WHEN regexp_matches(t, '{SCHEME}') THEN CASE WHEN regexp_matches(t, '{SCHEME}//') THEN t END WHEN instr(src, '://') = 0 THEN NULL
    WHEN starts_with(t, '/') THEN {part("src", ORIGIN)} || t WHEN starts_with(t, '?') THEN {part("src", ORIGIN)} || {part("src", PATH)} || t
    ELSE {part("src", ORIGIN)} || CASE WHEN {part("src", PATH)} = '' THEN '/' ELSE regexp_extract({part("src", PATH)}, '(?s)^(.*/)', 1) END || t END AS dst FROM targets),
e AS (SELECT DISTINCT src, dst FROM (SELECT {key("src")} AS src, {key("dst")} AS dst FROM ends WHERE dst IS NOT NULL) x WHERE src <> dst),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
urls AS (SELECT true AS page, page_id, url, {key("url")} AS k FROM pages UNION ALL SELECT false, NULL, b, b FROM (SELECT DISTINCT b FROM both_ways)),
judged AS (SELECT *, {case('r')} AS rule, {case('v')} AS own FROM (
  SELECT page, page_id, url, k, {low("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM (
    SELECT *, coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_replace(url, '(?s)^.*?://', '') ELSE '' END, '') AS rest FROM urls) v) w),
cls AS (SELECT r.a AS k, min(r.b) AS class_url, max(CASE WHEN j.own = 'block' THEN 1 ELSE 0 END) AS blk FROM reach r LEFT JOIN (SELECT DISTINCT k, own FROM judged WHERE NOT page) j ON j.k = r.b GROUP BY r.a)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.own, CASE WHEN c.blk = 1 THEN 'block' END, 'allow') AS verdict, coalesce(c.class_url, j.url) AS class_url
FROM judged j LEFT JOIN cls c ON c.k = j.k WHERE j.page"""
