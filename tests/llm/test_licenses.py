import random
import re

import pytest

from shelfrank.llm import licenses

TEXTS = [
    "Released under the MIT License.",
    "under the\tmit -- license, under THE MIT license",
    "Licensed under the Apache License, Version 2.0 (the rest)",
    "Apache License Version 2 cc by nc cc-by-nc",
    "CC BY-NC 4.0 and CC BY 3.0",
    "This work is licensed under the GNU General Public License, version 3",
    "GNU Affero General Public License version 3 or gpl v2 and LGPL 2.1 only",
    "SPDX-License-Identifier: BSD-3-Clause",
    "plain text about permits and simple examples",
    "mit license", "", None, "underthemitlicense", "É under the mit license é", "All rights reserved", "x " * 3000 + "under the mit license",
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(t):
    w = words(t)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for k in [phrase.split()] for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
    return len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, base string")
    return {r["doc_id"]: r for r in licenses.summary(licenses.scan(rows)).collect()}


def test_base_equals_brute_force(found):
    for i, t in enumerate(TEXTS):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def plain_spans(t):
    text = " " + " ".join(words(t)) + " "
    before, out = [0], []
    for c in text:
        before.append(before[-1] + (c == " "))
    for at, rule in enumerate(licenses.rules()):
        for m in re.finditer(rule.regex, text):
            start = before[m.start()]
            out.append((start, start + m[0].count(" "), rule.priority, at, rule.name))
    return out


def plain_rules(t):
    """Detections and their suppression, one pair at a time."""
    out = plain_spans(t)
    order = sorted(out, key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return [d for k, d in enumerate(order) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in order[:k])]


def test_detections_equal_brute_force(found):
    for i, t in enumerate(TEXTS):
        assert [(d["start"], d["end"], d["priority"], d["rule"]) for d in found[i]["detections"]] == [(a, b, p, n) for a, b, p, _, n in plain_rules(t)], t


def test_labels(found):
    assert found[2]["labels"] == "apache-2" and found[0]["labels"] == "mit"
    assert found[4]["labels"] == "cc-by-3,cc-by-nc,cc-by-nc-4"
    assert found[5]["labels"] == "gpl-3"
    assert found[6]["labels"] == "agpl-3,gpl-2,lgpl-2.1"
    assert found[7]["labels"] == "bsd-3"
    assert found[8]["labels"] == found[10]["labels"] == found[11]["labels"] == ""


def test_every_rule_fits_the_trace_and_its_keyword():
    assert len(licenses.rules()) > 300 and len({r.name for r in licenses.rules()}) == len(licenses.rules())
    trace = re.compile(licenses.trace())
    for rule in licenses.rules():
        sample = rule.regex.replace("(?= )", "")
        sample = re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", sample)
        while re.search(r"\(\?:", sample):  # the last of alternatives, without what is optional
            sample = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] else m[1].split("|")[-1], sample)
        sample = re.sub(r"\[([^^])[^]]*\]", r"\1", sample).replace(" ?", " ").replace("[^ ]+", "some")
        assert re.search(rule.regex, sample + " "), (rule, sample)
        assert rule.keyword in sample, (rule, sample)
        assert trace.search(" " + sample), (rule, sample)


def test_native_and_row_by_row(spark, docs, no_docs):
    found = licenses.scan(docs)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == docs.count() and licenses.scan(no_docs).count() == 0


def test_bodies_without_a_name(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd",
        "Neither the name of the copyright holder nor the names of its\n contributors may be used to endorse or promote products derived from this software": "bsd-3",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Unless required, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even": "gpl",
        "see https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2", "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc-4",
        "The Software shall be used for Good, not Evil.": "json",
        "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.": "bsd",
        "See the License for the specific language governing permissions and\n limitations under the License.": "apache-2",
        "As a special exception, the copyright holders of this library give you\npermission to link this library with independent modules": "gpl-classpath",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted": "postgresql",
        "You can redistribute it and/or modify it under the same terms as Perl itself": "perl", "Licensed under the Open Software License version 3.0": "osl-3",
        "The author disclaims copyright to this source code. In place of a legal notice, here is a blessing:": "sqlite-blessing",
        "Business Source License 1.1": "busl-1.1", "Server Side Public License, version 1": "sspl-1", "Llama 3.1 Community License Agreement": "llama",
        "THE SOFTWARE IS LICENSED, NOT SOLD: this software is licensed, not sold.": "proprietary",
        "Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3",
    }
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    found = {r["text"]: r["labels"].split(",") for r in licenses.summary(licenses.scan(rows)).collect()}
    assert {x: label in found[x] for x, label in texts.items()} == dict.fromkeys(texts, True), found


def test_very_many_matches_in_one_text(spark):
    """Twenty thousand matches, nested ones among them, against brute force."""
    rng = random.Random(4)
    text = " ".join(rng.choice(["mit license", "licensed under the mit license", "Apache License, Version 2.0", "word", "subject to the gpl v3"]) for _ in range(20_000))
    r = licenses.summary(licenses.scan(spark.createDataFrame([(text,)], "text string"))).first()
    wanted = sorted(plain_spans(text), key=lambda d: (d[0], -d[1], -d[2], d[3]))
    furthest, kept = {}, []
    for start, end, priority, _, name in wanted:
        if not any(e >= end for p, e in furthest.items() if p >= priority):
            kept.append((start, end, priority, name))
        furthest[priority] = max(furthest.get(priority, -1), end)
    assert len(kept) > 14_000 and [(d["start"], d["end"], d["priority"], d["rule"]) for d in r["detections"]] == kept
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)


def test_only_ascii_letters_are_lower_cased(spark):
    rows = spark.createDataFrame([("under the M\u0130T license",), ("\u212aeep under the mit license",)], "text string")
    assert [r["n_base"] for r in licenses.summary(licenses.scan(rows)).collect()] == [0, 1]


def test_names_of_its_own_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([("x", 1)], "text string, __words int"))
    kept = licenses.scan(spark.createDataFrame([("mit license", 1, 2)], "text string, w int, detections int"))
    assert kept.columns.count("detections") == 1 and kept.first()["w"] == 1


def test_real_lines(spark):
    lines = {
        "Apache License v2.0": "apache-2", "Apache License, v2": "apache-2", "Apache License, Version 2.0": "apache-2", "GNU General Public License v3": "gpl-3",
        "GNU General Public License, version 2": "gpl-2", "under GPLv3 here": "gpl-3", "GNU LGPL v2.1": "lgpl-2.1", "Mozilla Public License v. 2.0": "mpl-2",
        "Boost Software License v1.0": "boost-1",
    }
    ids = {"OFL-1.1": "ofl-1.1", "BSL-1.0": "boost-1", "MS-PL": "ms-pl", "ODbL-1.0": "odbl", "PSF-2.0": "psf-2", "PDDL-1.0": "public-domain", "GFDL-1.3-only": "fdl-1.3", "Apache-2.0": "apache-2", "GPL-3.0-or-later": "gpl-3", "MIT": "mit", "BSD-3-Clause": "bsd-3"}
    lines |= {f"// SPDX-License-Identifier: {x}": label for x, label in ids.items()}
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    found = {r["text"]: r["labels"].split(",") for r in licenses.summary(licenses.scan(rows)).collect()}
    assert {x: label in found[x] for x, label in lines.items()} == dict.fromkeys(lines, True), found
