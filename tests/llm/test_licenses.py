import re

from pyspark.sql import functions as F

from locuskit.llm.common import alnum_words
from locuskit.llm.licenses import BASE, license_scan, signatures

TEXTS = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
         "SPDX-License-Identifier: BSD-3-Clause\nmit license MIT-License", None, "", "..", "no words here at all",
         "permit license submit", "é mit licenseé mit license", "Licence: see the Apache licence v2.0 and MIT license"]
TEXTS.append(" ".join(["x MIT license, gnu general public license v2;"] * 700))


def brute(text, rules):
    words = alnum_words(text)
    norm = " " + " ".join(w.decode() for w in words) + " "
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            found.append((norm[:m.start()].count(" ") - 1, norm[:m.end()].count(" "), r.priority, n, r.label))
    kept = [d for d in found if not any(
        e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3])))
        for e in found)] if len(found) < 400 else None
    base = [(i, lab) for p, lab in BASE.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.encode().split()]
    return len(words), sorted(base), None if kept is None else sorted((d[0], d[1], d[4]) for d in kept)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i % 5 or None, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:2])],
                               "doc_id int, text string, start string")
    rules = signatures()
    rows = license_scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        n, base, kept = brute(r["text"], rules)
        assert r["license_words"] == n
        assert sorted((b["start"], b["label"]) for b in r["license_base"]) == base
        if kept is not None:
            assert sorted((s["start"], s["end"], s["label"]) for s in r["license_spans"]) == kept
    by = {r["text"]: r for r in rows}
    assert [s["label"] for s in by[TEXTS[1]]["license_spans"]] == ["apache-2.0"]
    assert [s["label"] for s in by[TEXTS[2]]["license_spans"]] == ["gpl-3.0"]
    assert [s["label"] for s in by[TEXTS[3]]["license_spans"]] == ["cc-by-nc-4.0"]
    assert by[TEXTS[8]]["license_score"] == 0 and by[TEXTS[4]]["license_score"] == 1


def test_keywords_never_hide_a_rule():
    """Texts written out of each pattern, every branch and option taken in turn, hold a keyword."""
    import random
    r = random.Random(1)

    def written(p):
        out, at = "", 0
        while at < len(p):
            if p[at] == "(":
                depth, end = 0, at
                while True:
                    depth += (p[end] == "(") - (p[end] == ")")
                    end += 1
                    if depth == 0:
                        break
                body, at = p[at + 1:end - 1], end
                text = ""
                if body.startswith("?:"):
                    depth, parts = 0, [""]
                    for c in body[2:]:
                        depth += (c == "(") - (c == ")")
                        if c == "|" and depth == 0:
                            parts.append("")
                        else:
                            parts[-1] += c
                    text = written(r.choice(parts))
            elif p[at] == "[":
                end = p.index("]", at)
                text, at = p[at + 1], end + 1
            else:
                text, at = p[at], at + 1
            if p[at:at + 1] in ("?", "*", "+"):
                text, at = ("" if p[at] != "+" and r.random() < 0.5 else text), at + 1
            out += text
        return out
    rules = signatures()
    assert 300 < len(rules) < 600 and all(k for x in rules for k in x.keywords)
    for x in rules:
        for _ in range(12):
            text = " " + written(x.pattern) + " "
            assert re.search(f"(?<= )(?:{x.pattern})(?= )", text), (x.pattern, text)
            assert any(f" {k}" in text for k in x.keywords), (x, text)


def test_mentions_without_the_word_license(spark):
    texts = {"Released under the MPL 2.0.": "mpl-2.0", "Covered by GPL v3": "gpl-3.0", "see https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
             "GPL-2.0-or-later": "gpl-2.0-or-later", "licensed under GPL v2 or any later version": "gpl-2.0-or-later",
             "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later", "GPL-2.0-only": "gpl-2.0"}
    rows = license_scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["text"]: [s["label"] for s in r["license_spans"]] for r in rows} == {t: [x] for t, x in texts.items()}


def test_no_python_in_the_plan(spark):
    df = license_scan(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert license_scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert df.select(F.size("license_spans")).first()[0] == 0
