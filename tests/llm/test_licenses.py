import random
import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from kgraph.llm import licenses


def example(parsed, pick):
    """A text that an expression matches."""
    out = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "NOT_LITERAL":
            out.append("x")
        elif name == "IN":
            first = pick.choice(value)
            if str(first[0]) == "NEGATE":
                out.append("x")
            else:
                out.append(chr(first[1] if str(first[0]) == "LITERAL" else first[1][0]))
        elif name == "MAX_REPEAT":
            low, high, inner = value
            for _ in range(pick.randint(low, min(high, low + 2))):
                out.append(example(inner, pick))
        elif name == "SUBPATTERN":
            out.append(example(value[3], pick))
        elif name == "BRANCH":
            out.append(example(pick.choice(value[1]), pick))
        else:
            raise ValueError(name)
    return "".join(out)


def test_every_match_holds_its_rules_keywords_and_a_gate():
    pick = random.Random(5)
    assert len(licenses.RULES) > 300
    gate_of_texts = re.compile(licenses._GATE)
    for _, _, priority, gate, word, expression in licenses.RULES:
        assert priority in licenses.SCORES
        for _ in range(30):
            match = example(_parser.parse(expression), pick)
            assert re.fullmatch(expression, match), (expression, match)
            assert re.fullmatch(r"( [^ ]+ )+", match), (expression, match)
            assert gate in match and word in match, (gate, word, match)
            assert gate_of_texts.search(match.replace("  ", "-")), match


def plain_scan(text):
    """(words, base places, kept findings) by the rules, one by one."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spaced = "".join(f" {w} " for w in words)
    starts, at = {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 2
    found = []
    for rule, label, priority, _, _, expression in licenses.RULES:
        for m in re.finditer(expression, spaced):
            start = starts[m.start()]
            found.append((rule, label, priority, start, start + m.group().count(" ") // 2 - 1))
    def outranks(b, a):
        if b[2] < 0 or not (b[3] <= a[3] and b[4] >= a[4]):
            return False
        return (b[2], b[3] - b[4], b[0]) < (a[2], a[3] - a[4], a[0])
    kept = [a for a in found if a[2] < 0 or not any(outranks(b, a) for b in found)]
    return len(words), kept


TEXTS = [
    None, "", " . ", "no words about it", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3.", "under CC BY-NC 4.0 and CC-BY-NC-SA 3.0 and cc by",
    "SPDX-License-Identifier: GPL-2.0-or-later\n// and the lesser general public license v2.1",
    "under the MIT license " * 40 + "Apache license version 2" * 3, "UNDER THE MİT LICENSE under the mit licenses",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction", "Copyright (c) 2020 Some Body. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-clause license",
    "Proprietary and confidential. See the end user licence agreement.", "creative commons attribution-noncommercial 4.0 international",
    "Ünder the mit license; 日本 under the mit license", "cc by nc cc by nc cc by by nc", "GPLv3, LGPL v2.1; GNU AGPLv3",
]


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    texts, findings = licenses.scan(df)
    ids = {r.row: r.doc_id for r in texts.collect()}
    return {r.doc_id: r.n_words for r in texts.collect()}, [(ids[r.row], r) for r in findings.collect()]


def test_findings_are_those_of_a_plain_scan(scanned):
    counts, findings = scanned
    for i, text in enumerate(TEXTS):
        n, kept = plain_scan(text)
        assert counts[i] == n
        mine = sorted((r.rule, r.label, r.priority, r.start, r.end) for key, r in findings if key == i)
        assert mine == sorted(kept), text


def test_spans_carry_their_words(scanned):
    _, findings = scanned
    words = {r.words for key, r in findings if key == 4}
    assert words == {"under the mit license", "released under the mit license"}
    assert {r.label for key, r in findings if key == 6} == {"gpl-3"}
    assert "cc-by-nc-sa" in {r.label for key, r in findings if key == 7}
    assert {r.label for key, r in findings if key in (1, 3)} == set()


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (4, TEXTS[4]), (None, TEXTS[4]), (900, "w " * 200_000 + TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "n_words", "__found", "labels", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = licenses.op12_license_rules(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.collect()
    assert len(got) == len(rows) and sum(r.doc_id == 4 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
    for r in got:
        text = dict(rows)[r.doc_id]
        n, kept = plain_scan(text)
        base = [k for k in kept if k[2] < 0]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(k[3] for k in base), max(k[3] for k in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({k[1] for k in base}))
        assert r.labels == ",".join(sorted({k[1] for k in kept}))
        assert r.score == max((licenses.SCORES[k[2]] for k in kept), default=0.0)


def test_extra_columns_are_kept_and_clashing_ones_replaced(spark):
    df = spark.createDataFrame([(1, TEXTS[4], "k")], "id long, text string, `a.b` string").withColumn("row", F.lit("x"))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("_once", F.lit(2))
    texts, findings = licenses.scan(df)
    assert texts.columns == ["id", "a.b", "m", "_once", "n_words", "row"] and findings.count() == 2
    renamed = df.withColumnRenamed("text", "t.x")
    assert licenses.scan(renamed, "t.x")[1].count() == 2


def test_empty_table(spark):
    texts, findings = licenses.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert texts.collect() == [] and findings.collect() == []
