"""License detection by ordered signature rules, in DataFrame expressions only.

Texts become lower-case words joined by single blanks. A keyword gate leaves few documents;
for those, each rule of whose keywords one occurs is tried. Its matches are marked in the text,
so that one pass over the words gives their word positions. Detections are sorted, and one
fold drops those contained in a detection of the same or a better priority. Nothing is
shuffled and no document's detections leave its row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import ascii_lower, prepare

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base detection (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_V = r"(?: version| v)?"
_L = r"licen[sc]e"
#: label, short name after "licensed under", full name, SPDX name, address; words as normalised.
FAMILIES = [
    ("mit", "(?:expat|mit(?: expat)?)", f"(?:mit|expat) {_L}", "mit", "opensource org licenses mit"),
    ("apache-1.1", f"apache{_V} 1 1", f"apache (?:software )?{_L}{_V} 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", f"apache{_V} 2(?: 0)?", f"apache (?:software )?{_L}{_V} 2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("gpl-1.0", f"gpl{_V} ?1(?: 0)?", f"general public {_L}{_V} 1(?: 0)?", "gpl 1 0", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", f"gpl{_V} ?2(?: 0)?", f"(?<!lesser )(?<!library )general public {_L}{_V} 2(?: 0)?", "gpl 2 0", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", f"gpl{_V} ?3(?: 0)?", f"(?<!lesser )(?<!affero )general public {_L}{_V} 3(?: 0)?", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", f"lgpl{_V} ?2(?: 0)?", f"library general public {_L}{_V} 2(?: 0)?", "lgpl 2 0", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", f"lgpl{_V} ?2 1", f"lesser general public {_L}{_V} 2 1", "lgpl 2 1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", f"lgpl{_V} ?3(?: 0)?", f"lesser general public {_L}{_V} 3(?: 0)?", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", f"agpl{_V} ?3(?: 0)?", f"affero general public {_L}{_V} 3(?: 0)?", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", f"(?:gfdl{_V} ?1 3|fdl{_V} ?1 3)", f"free documentation {_L}{_V} 1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("bsd-2-clause", "bsd (?:2|two) clause", f"(?:(?:simplified|2 clause|two clause) bsd|freebsd) {_L}", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd (?:3|three) clause", f"(?:new|modified|revised|3 clause|three clause) bsd {_L}", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd (?:4|four) clause", f"(?:original|4 clause|four clause) bsd {_L}", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "(?:0bsd|zero clause bsd)", f"(?:zero clause|0 clause) bsd {_L}", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc", f"isc {_L}", "isc", "opensource org licenses isc"),
    ("mpl-1.1", f"mpl{_V} ?1 1", f"mozilla public {_L}{_V} 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", f"mpl{_V} ?2 0", f"mozilla public {_L}{_V} 2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", f"epl{_V} ?1 0", f"eclipse public {_L}{_V} 1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", f"epl{_V} ?2 0", f"eclipse public {_L}{_V} 2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    ("eupl-1.2", f"eupl{_V} ?1 2", f"european union public {_L}{_V} 1 2", "eupl 1 2", "joinup ec europa eu software page eupl"),
    ("cddl-1.0", f"cddl{_V} ?1 0", f"common development and distribution {_L}{_V} 1 0", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl-1.0", f"cpl{_V} ?1 0", f"common public {_L}{_V} 1 0", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("artistic-1.0", f"artistic{_V} 1 0", f"artistic {_L}{_V} 1 0", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", f"artistic{_V} 2 0", f"artistic {_L}{_V} 2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("bsl-1.0", f"boost{_V} 1 0", f"boost software {_L}{_V} 1 0", "bsl 1 0", "boost org license 1 0"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", f"wtfpl {_L}", "wtfpl", "wtfpl net licenses"),
    ("ofl-1.1", f"ofl{_V} ?1 1", f"(?:sil )?open font {_L}{_V} 1 1", "ofl 1 1", "scripts sil org licenses ofl"),
    ("python-2.0", "(?:psf|python)", f"python software foundation {_L}", "python 2 0", "docs python org license"),
    ("php-3.01", "php 3 01", f"php {_L}{_V} 3 01", "php 3 01", "php net license 3 01"),
    ("ruby", "ruby", f"ruby {_L}", "ruby", "ruby lang org license"),
    ("postgresql", "postgresql", f"postgresql {_L}", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", f"openssl {_L}", "openssl", "openssl org source license"),
    ("x11", "x11", f"x11 {_L}", "x11", "spdx org licenses x11"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa", "opensource org licenses ncsa"),
    ("afl-3.0", f"afl{_V} ?3 0", f"academic free {_L}{_V} 3 0", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3.0", f"osl{_V} ?3 0", f"open software {_L}{_V} 3 0", "osl 3 0", "opensource org licenses osl 3 0"),
    ("ms-pl", "ms pl", f"microsoft public {_L}", "ms pl", "microsoft com opensource licenses ms pl"),
    ("ms-rl", "ms rl", f"microsoft reciprocal {_L}", "ms rl", "microsoft com opensource licenses ms rl"),
    ("cecill-2.1", f"cecill{_V} 2 1", f"cecill free software {_L}{_V} 2 1", "cecill 2 1", "cecill info licences licence cecill v2 1"),
    ("odbl-1.0", "odbl(?: 1 0)?", f"open database {_L}", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc by", f"open data commons attribution {_L}", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl", f"public domain dedication and {_L}", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1.0", "cc0(?: 1 0)?", f"cc0(?: 1 0)?(?: universal)? {_L}", "cc0 1 0", "creativecommons org publicdomain zero 1 0 licen[sc]e"),
    ("llama-community", "llama", f"llama [0-9 ]*community {_L}", "llama", "llama com license"),
    ("openrail", "(?:openrail(?: m)?|open rail(?: m)?|rail(?: m)?)", f"(?:open )?rail(?: m)? {_L}", "openrail", "licenses ai openrail license"),
    ("busl-1.1", "(?:busl 1 1|bsl 1 1)", f"business source {_L}{_V} 1 1", "busl 1 1", "mariadb com bsl11 license"),
    ("sspl-1.0", "sspl", f"server side public {_L}", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", f"elastic{_V} 2(?: 0)?", f"elastic {_L}{_V} 2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license"),
]
#: Creative Commons licenses by parts and version.
for _parts, _names in {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv[a-z]+",
                       "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike",
                       "by nc nd": "attribution non ?commercial no ?deriv[a-z]+"}.items():
    for _version in ("2 0", "3 0", "4 0"):
        FAMILIES.append((f"cc-{_parts.replace(' ', '-')}-{_version.replace(' ', '.')}", f"cc {_parts} {_version}",
                         f"creative commons {_names} {_version}(?: international| unported)? {_L}",
                         f"cc {_parts} {_version}", f"creativecommons org licenses {_parts} {_version}"))


@dataclass(frozen=True)
class Rule:
    """``priority`` 1 is the best; ``pattern`` matches whole normalised words."""

    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def _alternatives(pattern: str) -> list[str]:
    """The branches of a pattern that is one group, else the pattern itself."""
    if not pattern.startswith("(?:") or not pattern.endswith(")"):
        return [pattern]
    depth, parts, inner = 0, [""], pattern[3:-1]
    for c in inner:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return [pattern]
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def held(pattern: str) -> tuple[str, ...]:
    """Texts of which every match holds one: the longest plain stretch of words of each branch.

    What stands in groups or is optional is not counted; a stretch begins with a word.
    """
    out = []
    for branch in _alternatives(pattern):
        depth, plain = 0, ""
        for c in branch.replace("licen[sc]e", "licen|"):
            depth += c == "("
            plain += c if depth == 0 else "|"
            depth -= c == ")"
        plain = re.sub(r"\|\?|.\?|\[[^\]]*\][+*]?", "|", plain)
        found = re.findall(r"(?:^| )([a-z0-9][a-z0-9 ]*)", plain)
        out.append(max([f.strip() for f in found], key=len, default=""))
    return tuple(out)


def _any_of(texts: list[str]) -> str:
    """A pattern that matches where one of the texts begins: equal beginnings are written once.

    Alternatives thus differ in their first letter, and a place that fits none is left at once.
    """
    if "" in texts:
        return ""
    heads: dict[str, list[str]] = {}
    for t in texts:
        heads.setdefault(t[0], []).append(t[1:])
    parts = [c + _any_of(rest) for c, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def signatures() -> list[Rule]:
    """Rules of each family and the base phrases, best first.

    A rule's keywords are texts of which every match of its pattern holds one, so that no rule is
    kept from a text it could match.
    """
    out = []
    verbs = "(?:(?:dual |re)?licen[sc]ed|released|distributed|available|covered|published|provided|offered|governed)"
    under = r"(?:under|subject to|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu)?"
    later = "(?: or(?: at your option)?(?: any)? later(?: version)?| or newer)"
    add = lambda label, priority, weight, pattern, core=None: out.append(
        Rule(label, priority, weight, held(core or pattern), pattern))
    for label, short, full, spdx, site in FAMILIES:
        add(label, 1, 1.0, f"spdx {_L} identifier {spdx}")
        add(label, 2, 0.9, f"{verbs} {under} {full}", full)
        add(label, 2, 0.9, f"{verbs} {under} {short}", short)
        add(label, 4, 0.6, full)
        add(label, 3, 0.8, f"(?:www )?{site}", site)
        if re.match("(?:l|a)?gpl|gfdl", label):
            add(f"{label}-or-later", 1, 1.0, f"spdx {_L} identifier {spdx} or later")
            add(f"{label}-or-later", 2, 0.9, f"{verbs} {under} {short}{later}", short)
            add(f"{label}-or-later", 2, 0.9, f"{verbs} {under} {full}{later}", full)
            add(f"{label}-or-later", 3, 0.8, f"{spdx} or later")
            add(label, 3, 0.8, f"{spdx} only")
    out += [Rule(label, 5, 0.5, (phrase,), phrase) for phrase, label in BASE.items()]
    return sorted(out, key=lambda r: (r.priority, r.label, r.pattern))


PRIORITIES = 5
SPAN = "struct<start:int,back:int,priority:int,rule:int,label:string,weight:double>"


def normal(text: Column) -> Column:
    """Words with a blank around each; a single blank if there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " ")), F.lit(" "))


def _places(norm: Column, pattern: Column) -> Column:
    """(start, end) in words of each match, end exclusive; linear in the text."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit("\x01$0\x02"))
    words = F.split(F.trim(marked), " ")
    at = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    return F.zip_with(at(lambda w: w.startswith("\x01")), at(lambda w: w.endswith("\x02")),
                      lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))


def _detections(norm: Column, rules: list[Rule]) -> Column:
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                               F.lit(r.weight).alias("weight"),
                               F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
                               F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules)])
    tried = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, F.concat(F.lit(" "), k))) & F.regexp_like(
        norm, F.concat(F.lit("(?<= )(?:"), r["pattern"], F.lit(")(?= )"))))
    return F.flatten(F.transform(tried, lambda r: F.transform(_places(norm, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"),
        r["label"].alias("label"), r["weight"].alias("weight")))))


def _resolved(found: Column) -> Column:
    """Detections not contained in one of the same or a better priority.

    Sorted by start, then longest and best first, all that can contain a detection stand
    before it; the fold carries the furthest end so far of each priority.
    """
    def step(acc, d):
        covered = F.array_max(F.slice(acc["ends"], F.lit(1), d["priority"])) >= -d["back"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == d["priority"], F.greatest(e, -d["back"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(covered, acc["kept"]).otherwise(
            F.concat(acc["kept"], F.array(d))).alias("kept"))
    start = F.struct(F.array(*[F.lit(-1)] * PRIORITIES).alias("ends"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    return F.aggregate(F.sort_array(found), start, step, lambda acc: acc["kept"])


def license_scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with columns license_words, license_base (places of base phrases: start, label),
    license_spans (kept detections: start, end in words, label, weight) and license_score.

    Null and empty texts have no words and no detections. Repeated rows, null ids and other
    columns pass through. A document's detections are one array: its size is the number of
    its license mentions. The score is the best weight among the kept detections, 0 if none.
    """
    prepare(docs.sparkSession)
    own = [f"`{c}`" for c in docs.columns if not c.startswith("license_")]
    step = docs.select(*own, normal(F.col(text)).alias("license_norm"))
    norm = F.col("license_norm")
    rules = rules or signatures()
    keywords = sorted({k for r in rules for k in r.keywords})
    # one pass over the words tells which texts hold any rule's keyword
    gate = norm.rlike(" " + _any_of(keywords))
    base = F.flatten(F.array(*[_labelled(_places(norm, F.lit(p)), label) for p, label in BASE.items()]))
    words = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit(""))) - 1
    step = step.select(
        *own, F.when(norm == "  ", F.lit(0)).otherwise(words).cast("bigint").alias("license_words"),
        F.when(F.contains(norm, F.lit("license")), base).alias("license_base"),
        F.when(gate, _detections(norm, rules)).alias("license_found"))
    step = step.select(*own, "license_words", "license_base",
                       F.when(F.size("license_found") > 0, _resolved(F.col("license_found"))).alias("license_kept"))
    spans = F.transform("license_kept", lambda d: F.struct(
        d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["weight"].alias("weight")))
    return step.select(
        *own, "license_words", F.coalesce("license_base", F.array().cast("array<struct<start:int,label:string>>")).alias("license_base"),
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>")).alias("license_spans"),
        F.coalesce(F.array_max(F.transform("license_kept", lambda d: d["weight"])), F.lit(0.0)).alias("license_score"))
