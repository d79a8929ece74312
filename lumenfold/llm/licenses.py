"""Licence scan by sentence rules (native: DataFrame functions only).

A text is cut into sentences: at blank lines and at . ! ? before white space, but not at line breaks, because licence texts are wrapped.
Each sentence is normalised (ASCII lower case, runs of other than letters, digits, '.' and '+' become one space), and every known licence
sentence in it is replaced by its identifier, the more specific first. Some identifiers name a licence by themselves (GPL-2.0-or-later);
others are parts of a licence's text (MitGrant). The sequence of identifiers, in text order, is then matched against ordered licence
rules. A rule takes only identifiers that it names, so a file under two licences names both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to 200 characters of a sentence (sentences stand between bars) that no identifier has taken.
GAP = r"[^|<]{0,200}?"
LICENCE = r"licen[cs]e"
#: The public licences that come in numbered versions: (identifier, names, versions as written, version in the identifier).
GNU = [
    ("AGPL", rf"gnu affero general public {LICENCE}|affero general public {LICENCE}|gnu affero gpl|gnu agpl|agpl", [("3", "3.0")]),
    ("LGPL", rf"gnu (?:lesser|library) general public {LICENCE}|lesser general public {LICENCE}|gnu lgpl|lgpl", [(r"2\.1", "2.1"), ("2", "2.0"), ("3", "3.0")]),
    ("GPL", rf"gnu general public {LICENCE}|gnu gpl|gpl", [("1", "1.0"), ("2", "2.0"), ("3", "3.0")]),
    ("GFDL", rf"gnu free documentation {LICENCE}|gnu fdl|gfdl", [(r"1\.1", "1.1"), (r"1\.2", "1.2"), (r"1\.3", "1.3")]),
]
NUMBERED = [
    ("MPL", rf"mozilla public {LICENCE}|mpl", r"1\.0|1\.1|2\.0"), ("EPL", rf"eclipse public {LICENCE}|epl", r"1\.0|2\.0"), ("EUPL", rf"european union public {LICENCE}|eupl", r"1\.1|1\.2"),
    ("CDDL", rf"common development and distribution {LICENCE}|cddl", r"1\.0|1\.1"), ("OFL", rf"sil open font {LICENCE}|open font {LICENCE}|ofl", r"1\.0|1\.1"), ("Artistic", rf"artistic {LICENCE}|artistic", r"1\.0|2\.0"),
    ("BSL", rf"boost software {LICENCE}", r"1\.0"), ("AFL", rf"academic free {LICENCE}", r"2\.1|3\.0"), ("OSL", rf"open software {LICENCE}", r"2\.1|3\.0"),
]
#: Creative Commons licences: (identifier, words after 'cc', words after 'creative commons' or alone).
COMMONS = [
    ("CC-BY-NC-SA", "by nc sa", "attribution non ?commercial share ?alike"), ("CC-BY-NC-ND", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"), ("CC-BY-NC", "by nc", "attribution non ?commercial"),
    ("CC-BY-SA", "by sa", "attribution share ?alike"), ("CC-BY-ND", "by nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("CC-BY", "by", "attribution"),
]
#: Titles of whole licence texts, which mention their own family: (licence, title, identifiers that the text itself holds).
TEXTS = [
    ("AGPL-3.0", rf"gnu affero general public {LICENCE} version 3 19 november 2007", r"=A?GPL-3\.0(?:-or-later)?"), ("LGPL-3.0", rf"gnu lesser general public {LICENCE} version 3 29 june 2007", r"=L?GPL-3\.0(?:-or-later)?"),
    ("GPL-3.0", rf"gnu general public {LICENCE} version 3 29 june 2007", r"=A?GPL-3\.0(?:-or-later)?"), ("LGPL-2.1", rf"gnu lesser general public {LICENCE} version 2\.1 february 1999", r"=L?GPL-2\.[01](?:-or-later)?"),
    ("LGPL-2.0", rf"gnu library general public {LICENCE} version 2 june 1991", r"=L?GPL-2\.0(?:-or-later)?"), ("GPL-2.0", rf"gnu general public {LICENCE} version 2 june 1991", r"=GPL-2\.0(?:-or-later)?"),
    ("GPL-1.0", rf"gnu general public {LICENCE} version 1 february 1989", r"=GPL-1\.0(?:-or-later)?"), ("GFDL-1.2", rf"gnu free documentation {LICENCE} version 1\.2 november 2002", r"=GFDL-1\.2(?:-or-later)?"),
    ("GFDL-1.3", rf"gnu free documentation {LICENCE} version 1\.3 3 november 2008", r"=GFDL-1\.3(?:-or-later)?|=CC-BY-SA-3\.0"), ("MPL-1.1", rf"\|mozilla public {LICENCE} version 1\.1\|", r"=MPL-1\.1"),
    ("Apache-2.0", rf"apache {LICENCE} version 2\.0 january 2004", r"=Apache-2\.0"), ("MPL-2.0", rf"\|mozilla public {LICENCE} version 2\.0\|", r"=MPL-2\.0|GplShort|=(?:A|L)?GPL-[0-9.]+(?:-or-later)?"),
]
#: Other sentences: (identifier, pattern). '=' marks identifiers that name a licence by themselves.
OTHERS = [
    ("GplSee", rf"(?:see the|copy of the|terms of the) gnu (?:lesser |library |affero )?general public {LICENCE}(?: for more details| along with| as well)"),
    ("=Apache-2.0", rf"\bapache(?: software)? {LICENCE}(?: v| version)? ?2(?:\.0)?\b|\bapache {LICENCE}{GAP}\bversion 2(?:\.0)?\b|\bapache v?2(?:\.0)?\b"), ("=Apache-1.1", rf"\bapache(?: software)? {LICENCE}(?: v| version)? ?1\.1\b"),
    ("=CC0-1.0", r"\bcc0\b(?: 1\.0)?|\bcreative commons zero\b"), ("=Unlicense", r"\bfree and unencumbered software released(?: into the public domain)?|\bunlicense\b"),
    ("=Public-Domain", r"\b(?:released|dedicated|placed|is) (?:in ?)?(?:to )?the public domain\b"), ("=WTFPL", rf"\bdo what the fuck you want to public {LICENCE}|\bwtfpl\b"), ("=Zlib", rf"\bzlib {LICENCE}\b"),
    ("=BSD-3-Clause", r"\bbsd 3 clause\b|\b(?:3|three) clause bsd\b|\b(?:new|modified|revised) bsd\b"), ("=BSD-2-Clause", r"\bbsd 2 clause\b|\b(?:2|two) clause bsd\b|\bsimplified bsd\b"),
    ("=ISC", rf"\bisc {LICENCE}\b|\b(?:identifier|{LICENCE}) isc\b"), ("=MIT", rf"\b(?:mit|expat) {LICENCE}\b|\b(?:identifier|{LICENCE}|under the|under) (?:mit|expat)\b"),
    ("MitGrant", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"), ("IscGrant", r"\bpermission to use copy modify and(?: or)? distribute this software for any purpose\b"),
    ("NoticeKept", r"\bpermission notice shall be included in all copies\b"), ("BsdGrant", r"\bredistribution and use in source and binary forms\b"), ("BsdSource", r"\bredistributions? of source code must retain\b"),
    ("BsdBinary", r"\bredistributions? in binary form must reproduce\b"), ("BsdAdvert", r"\ball advertising materials mentioning features or use of this software must display\b"),
    ("BsdEndorse", rf"\bneither the names? (?:of )?{GAP}endorse or promote\b|\bmay (?:not )?be used to endorse or promote products\b"), ("ZlibOrigin", r"\borigin of this software must not be misrepresented\b"),
    ("AsIs", rf"\bprovided (?:by {GAP})?as is\b"), ("Liability", r"\bin no event (?:shall|will)\b"), ("GplShort", rf"\b(?:gnu (?:lesser |library |affero )?general public {LICENCE}|(?:gnu )?[al]?gpl)\b"), ("BsdShort", rf"\bbsd (?:style )?{LICENCE}\b"),
    ("AllRights", r"\ball rights reserved\b"), ("Copyright", r"\|(?:copyright )+[^|<]*"), ("LicenceLike", rf"\|[^|<]*\b(?:licen[cs]ed? (?:under|as|is)|under the [^|<]*{LICENCE})\b[^|<]*\|"),
]
_FILL = r"(?:<(?:Copyright|AllRights|AsIs|Liability|LicenceLike)>)*"
_END = r"(?:<(?:AsIs|Liability)>)*"
#: Fixed values: (licence, sequence of identifiers), in order. A rule takes its identifiers away from those after it.
RULES = [(name, rf"<Text {name}>(?:<(?:{own}|Text {name}|GplSee|GplShort|Copyright|AsIs|Liability|AllRights|LicenceLike)>)*".replace(f"Text {name}", "Text " + name.replace(".", r"\."))) for name, _, own in TEXTS]
PARTS = [
    ("MIT", rf"<MitGrant>{_FILL}<NoticeKept>{_END}"),
    ("BSD-4-Clause", rf"<BsdGrant>{_FILL}<BsdSource>{_FILL}<BsdBinary>{_FILL}<BsdAdvert>{_FILL}<BsdEndorse>{_END}"),
    ("BSD-3-Clause", rf"<BsdGrant>{_FILL}<BsdSource>{_FILL}<BsdBinary>{_FILL}<BsdEndorse>{_END}"),
    ("BSD-2-Clause", rf"<BsdGrant>{_FILL}<BsdSource>{_FILL}<BsdBinary>{_END}"),
    ("ISC", rf"<IscGrant>{_END}"),
    ("Zlib", rf"<AsIs>{_FILL}<ZlibOrigin>"),
    ("MIT", r"<MitGrant>"),
]
#: Fixed values: (licence, identifier, licences beside which the identifier is only another mention).
SHORT = [("GPL-unversioned", "<GplShort>", "GPL-"), ("BSD-unversioned", "<(?:BsdShort|BsdGrant)>", "BSD-"), ("All-Rights-Reserved", "<AllRights>", ""), ("Unknown-License", "<LicenceLike>", None)]
#: Each pattern above needs a sentence with one of these.
TERMS = ["licen", "gpl", "apache", "mpl", "epl", "eupl", "cddl", "ofl", "artistic", "agpl", "domain", "unencumbered", "permission", "redistribut", "endors", "misrepresent", "copyright", "(c)", "©", "reserved", "attribution", "commons", "cc by", "cc-by", "cc0", "warrant", "bsd", "advertising", "in no event"]
#: Not an end of a sentence: the point of an abbreviation. Ends of sentences: blank lines, also of comments; . ! ? before white space or the end.
ABBREVIATED = r"\b(v|ver|inc|ltd|corp|co|no|al)\.(\s)"
END = r"\n[ \t\r*#;%/-]*\n|[.!?]+(?:\s|$)"


def sentences() -> list[tuple[str, str]]:
    """(pattern, identifier) in order; $1 in an identifier is the pattern's first group."""
    out = [(title, f"Text {name}") for name, title, _ in TEXTS]
    out.append((dict(OTHERS)["GplSee"], "GplSee"))
    for family, names, versions in GNU:
        for written, version in versions:
            number = rf"{written}(?:\.0)?"
            later = r"(?: of the licen[cs]e)?(?: published by the free software foundation)?(?: only)? or (?:at your option )?(?:any )?(?:later|newer)"
            at = rf"\b(?:{names})(?: ?v?|{GAP}\bv(?:er|ersion)? ?){number}"
            before = rf"\bversion {number}"
            out += [(rf"{at}(?: ?\+|{later})|{before}(?:{later})(?: version)? of the (?:{names})", f"={family}-{version}-or-later")]
            out += [(rf"{at}\b(?: only)?|{before} of the (?:{names})\b", f"={family}-{version}")]
    out += [(rf"\b(?:{names})(?: v| version)? ?({versions})\b", f"={family}-$1") for family, names, versions in NUMBERED]
    out += [(rf"\b(?:cc {short}|(?:creative commons )?{long}) ?v?([1-4]\.[05])\b", f"={family}-$1") for family, short, long in COMMONS]
    return out + [(pattern, name) for name, pattern in OTHERS if name != "GplSee"]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any_term(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in TERMS])


def normalised(text: Column) -> Column:
    """The sentences of a text that hold a term, normalised, each between bars; a text without terms gives null."""
    likely = F.element_at(F.transform(F.array(F.lower(text)), _any_term), 1)  # a lambda's argument is computed once, not for each term
    whole = F.when(likely, _lower(text))
    cut = F.filter(F.split(F.regexp_replace(whole, ABBREVIATED, "$1$2"), END), _any_term)
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\(c\)|©", " copyright "), r"[^a-z0-9.+]+", " ")))
    return F.concat_ws("", F.transform(plain, lambda s: F.concat(F.lit("|"), s, F.lit("|"))))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in text order), licenses (sorted, each once), status for every row.

    status: 'known' (a licence named), 'unmatched' (licence sentences that no rule takes, such as a
    bare copyright line), 'none'. A null or empty text has empty arrays and 'none'. Repeated rows give repeated
    rows. Texts are scanned whole. Texts without any of TERMS skip the cutting: no pattern can match them.
    """
    marked = reduce(lambda c, s: F.regexp_replace(c, s[0], f"|<{s[1]}>" if s[1] == "Copyright" else f"<{s[1]}>"), sentences(), normalised(F.col("text")))
    found = docs.select("doc_id", F.coalesce(F.regexp_extract_all(marked, F.lit("<([^>]+)>"), F.lit(1)), F.array().cast("array<string>")).alias("_ids"))
    out = found.withColumn("_rest", F.concat_ws("", F.transform("_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))).withColumn("_hits", F.array().cast("array<string>"))

    def applied(df, name, pattern):
        hit = F.when(F.col("_rest").rlike(pattern), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        return df.select("doc_id", "_ids", F.regexp_replace("_rest", pattern, "").alias("_rest"), F.concat("_hits", hit).alias("_hits"))

    for name, pattern in RULES:
        out = applied(out, name, pattern)
    out = out.select("doc_id", "_ids", F.concat("_hits", F.regexp_extract_all("_rest", F.lit("<=([^>]+)>"), F.lit(1))).alias("_hits"), F.regexp_replace("_rest", "<=[^>]+>", "").alias("_rest"))
    for name, pattern in PARTS:
        out = applied(out, name, pattern)
    named = F.col("_hits")
    alone = lambda beside: F.lit(True) if beside is None else ~F.exists(named, lambda x: x.contains(beside))
    short = [F.when(F.col("_rest").rlike(p) & alone(beside), F.lit(n)) for n, p, beside in SHORT]
    licenses = F.array_sort(F.array_distinct(F.concat(named, F.filter(F.array(*short), lambda x: x.isNotNull()))))
    out = out.select("doc_id", F.transform("_ids", lambda x: F.regexp_replace(x, "^=", "")).alias("sentence_ids"), licenses.alias("licenses"))
    status = F.when(F.size("licenses") > 0, "known").when(F.size("sentence_ids") > 0, "unmatched").otherwise("none")
    return out.withColumn("status", status)


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda s: s.replace("'", "''")
    any_term = lambda c: "(" + " OR ".join(f"contains({c}, '{q(t)}')" for t in TERMS) + ")"
    marked = "bars"
    for pattern, name in sentences():
        marked = f"regexp_replace({marked}, '{q(pattern)}', '{'|' if name == 'Copyright' else ''}<{name.replace('$1', chr(92) + '1')}>', 'g')"
    steps, last = [], "ids"
    for i, (name, pattern) in enumerate([*RULES, (None, "<=[^>]+>"), *PARTS]):
        hit = f"CASE WHEN regexp_matches(rest, '{q(pattern)}') THEN ['{name}'] ELSE []::VARCHAR[] END" if name else "regexp_extract_all(rest, '<=([^>]+)>', 1)"
        steps.append(f"r{i} AS (SELECT doc_id, ids, hits || {hit} AS hits, regexp_replace(rest, '{q(pattern)}', '', 'g') AS rest FROM {last})")
        last = f"r{i}"
    short = ", ".join(f"CASE WHEN regexp_matches(rest, '{p}')" + ("" if b is None else f" AND len(list_filter(hits, lambda x: contains(x, '{b}'))) = 0") + f" THEN '{n}' END" for n, p, b in SHORT)
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(t, '{ABBREVIATED}', '\\1\\2', 'g'), '{END}'), lambda s: {any_term('s')}) AS ss FROM low),
normal AS (SELECT doc_id, coalesce(array_to_string(list_transform(ss, lambda s: '|' || trim(regexp_replace(regexp_replace(s, '\\(c\\)|©', ' copyright ', 'g'), '[^a-z0-9.+]+', ' ', 'g')) || '|'), ''), '') AS bars FROM cut),
found AS (SELECT doc_id, regexp_extract_all({marked}, '<([^>]+)>', 1) AS ids FROM normal),
ids AS (SELECT doc_id, ids, []::VARCHAR[] AS hits, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest FROM found),
{", ".join(steps)},
f AS (SELECT doc_id, ids, list_sort(list_distinct(hits || list_filter([{short}], lambda x: x IS NOT NULL))) AS licenses FROM {last})
SELECT doc_id, array_to_string(list_transform(ids, lambda x: ltrim(x, '=')), ',') AS sentence_ids, array_to_string(licenses, ',') AS licenses,
  CASE WHEN len(licenses) > 0 THEN 'known' WHEN len(ids) > 0 THEN 'unmatched' ELSE 'none' END AS status
FROM f"""


def op8(spark, sf_dir):
    from .common import table

    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("sentence_ids", "licenses")})
