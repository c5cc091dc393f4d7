"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and cut into words. Each rule is a regular expression over words with a label, a priority and
two keywords that every match holds. A text is looked at only if it holds some rule's gate, and a rule is run only where
the text holds both of its keywords, so most texts cost one search and a scanned text a few rules of some hundreds.

A finding is suppressed if another one covers its interval and outranks it: a smaller priority number wins, then
the longer interval, then the earlier rule. Findings of base rules (exact phrases) are never suppressed and suppress
nothing. One window over the findings of a text, ordered by start and falling end, decides this with a running
maximum of ends for each priority, so the work grows with the findings and no pair of them is made.

Texts are read once; what is written, shuffled and joined back afterwards are word counts and findings.

Defined cases: null and empty texts have no words and no findings; words are cut at every ASCII character that is neither
letter nor digit, so a text without them is one word; findings of one rule don't overlap each other; repeated rows have
the same findings each; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.functions.once import with_once
from kgraph.llm.common import clean_text, quoted, table, without
from kgraph.sources.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Priorities, the strongest first, and the score of a finding of each.
BASE, TEXT, NOTICE, REFERENCE, TITLE = -1, 0, 1, 2, 3
SCORES = {BASE: 1.0, TEXT: 1.0, NOTICE: 0.95, REFERENCE: 0.8, TITLE: 0.6}

#: Phrases that always count, with their labels.
PHRASES = [
    ("mit", "licen", "under the mit license"),
    ("apache-2", "licen", "apache license version 2"),
    ("cc-by-nc", "cc by", "cc by nc"),
]

#: Names of licenses: label, gate, second keyword, name as it is written, identifier in a machine-readable line.
#: Single spaces stand between words; a later name of the same text part is outranked by a longer one.
NAMES = [
    ("mit", "licen", "mit", "mit (?:expat )?(?:x11 )?licen[sc]e", "mit"),
    ("mit-0", "licen", "attribution", "mit no attribution licen[sc]e", "mit 0"),
    ("x11", "licen", "x11", "x11 licen[sc]e", "x11"),
    ("isc", "licen", "isc", "isc (?:open source )?licen[sc]e", "isc"),
    ("0bsd", "licen", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause) licen[sc]e", "0bsd"),
    ("bsd-2", "licen", "bsd", "(?:bsd (?:2|two) clause(?: simplified)?|(?:2|two) clause bsd|simplified bsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3", "licen", "bsd", "(?:bsd (?:3|three) clause(?: new)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4", "licen", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd) licen[sc]e", "bsd 4 clause"),
    ("bsd", "licen", "bsd", "bsd (?:style )?licen[sc]e", "bsd"),
    ("apache-1", "licen", "apache", "apache (?:software )?licen[sc]e (?:version |v )?1 [01]", "apache 1 [01]"),
    ("apache-2", "licen", "apache", "apache (?:software )?(?:2 0 licen[sc]e|licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?)", "apache 2 0"),
    ("apache", "licen", "apache", "apache (?:software )?licen[sc]e", "apache"),
    ("gpl-1", "licen", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:1|v1)(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "licen", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "licen", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:3|v3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "licen", "general public", "(?:gnu )?general public licen[sc]e", "gpl"),
    ("gpl-2", "gpl", "gpl", "(?:gnu )?(?:gpl (?:version |v )?2(?: 0)?|gplv2|gpl v2|gpl2)(?: licen[sc]e)?", None),
    ("gpl-3", "gpl", "gpl", "(?:gnu )?(?:gpl (?:version |v )?3(?: 0)?|gplv3|gpl v3|gpl3)(?: licen[sc]e)?", None),
    ("gpl", "gpl", "gpl", "(?:gnu gpl|gpl licen[sc]e|gpl compatible licen[sc]e)", None),
    ("lgpl-2", "licen", "public", "(?:gnu )?(?:lesser|library) general public licen[sc]e (?:version |v )?2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-3", "licen", "public", "(?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "licen", "public", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl"),
    ("lgpl-2", "gpl", "lgpl", "(?:gnu )?(?:lgpl (?:version |v )?2(?: [01])?|lgplv2|lgpl v2)(?: licen[sc]e)?", None),
    ("lgpl-3", "gpl", "lgpl", "(?:gnu )?(?:lgpl (?:version |v )?3(?: 0)?|lgplv3|lgpl v3)(?: licen[sc]e)?", None),
    ("agpl-3", "licen", "affero", "(?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "licen", "affero", "(?:gnu )?affero general public licen[sc]e", "agpl"),
    ("agpl-3", "gpl", "agpl", "(?:gnu )?(?:agpl (?:version |v )?3(?: 0)?|agplv3|agpl v3)(?: licen[sc]e)?", None),
    ("gfdl", "licen", "free documentation", "(?:gnu )?free documentation licen[sc]e(?: (?:version )?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "licen", "mozilla", "mozilla public licen[sc]e (?:version |v )?1 [01]", "mpl 1 [01]"),
    ("mpl-2", "licen", "mozilla", "mozilla public licen[sc]e (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("mpl", "licen", "mozilla", "mozilla public licen[sc]e", "mpl"),
    ("npl", "licen", "netscape", "netscape public licen[sc]e(?: (?:version |v )?1 [01])?", "npl 1 [01]"),
    ("epl-1", "licen", "eclipse", "eclipse public licen[sc]e (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2", "licen", "eclipse", "eclipse public licen[sc]e (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("epl", "licen", "eclipse", "eclipse (?:public|distribution) licen[sc]e", "epl"),
    ("eupl", "licen", "european union", "european union public licen[sc]e(?: (?:version |v )?1 [012])?", "eupl 1 [012]"),
    ("cddl", "licen", "development", "common development and distribution licen[sc]e(?: (?:version |v )?1 [01])?", "cddl 1 [01]"),
    ("cpl", "licen", "common public", "common public licen[sc]e(?: (?:version |v )?1 0)?", "cpl 1 0"),
    ("ipl", "licen", "ibm", "ibm public licen[sc]e(?: (?:version |v )?1 0)?", "ipl 1 0"),
    ("cc0", "creative commons", "zero", "creative commons zero(?: (?:v1|1) 0)?(?: universal)?(?: licen[sc]e)?", None),
    ("cc0", "cc0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: licen[sc]e)?", "cc0 1 0"),
    ("cc-by", "creative commons", "attribution", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc-by-sa", "creative commons", "alike", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc-by-nd", "creative commons", "deriv", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc-by-nc", "creative commons", "commercial", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc-by-nc-sa", "creative commons", "alike", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc-by-nc-nd", "creative commons", "deriv", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: licen[sc]e)?", None),
    ("cc", "creative commons", "licen", "creative commons licen[sc]e", None),
    ("cc-by", "cc by", "cc by", "cc by(?: [1-4] [05])?(?: licen[sc]e)?", "cc by [1-4] [05]"),
    ("cc-by-sa", "cc by", "sa", "cc by sa(?: [1-4] [05])?(?: licen[sc]e)?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by", "nd", "cc by nd(?: [1-4] [05])?(?: licen[sc]e)?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by", "nc", "cc by nc(?: [1-4] [05])?(?: licen[sc]e)?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by", "sa", "cc by nc sa(?: [1-4] [05])?(?: licen[sc]e)?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by", "nd", "cc by nc nd(?: [1-4] [05])?(?: licen[sc]e)?", "cc by nc nd [1-4] [05]"),
    ("artistic-2", "licen", "artistic", "artistic licen[sc]e (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "licen", "artistic", "(?:clarified |perl )?artistic licen[sc]e(?: 1 0)?", "artistic 1 0"),
    ("boost", "licen", "boost", "boost software licen[sc]e(?: (?:version |v )?1 0)?", "bsl 1 0"),
    ("zlib", "licen", "zlib", "(?:zlib(?: libpng)?) licen[sc]e", "zlib"),
    ("libpng", "licen", "png", "(?:libpng|png reference library) licen[sc]e(?: version 2)?", "libpng 2 0"),
    ("openssl", "licen", "openssl", "openssl licen[sc]e", "openssl"),
    ("postgresql", "licen", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("psf", "licen", "psf", "psf licen[sc]e(?: (?:agreement|version 2))?", None),
    ("python", "licen", "python", "python (?:software foundation )?licen[sc]e(?: (?:agreement|version 2))?", "(?:psf|python) 2 0"),
    ("php", "licen", "php", "php licen[sc]e(?: (?:version |v )?3 01?)?", "php 3 01?"),
    ("ruby", "licen", "ruby", "ruby licen[sc]e", "ruby"),
    ("unlicense", "licen", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "licen", "what", "do what the [^ ]+ you want to public licen[sc]e", "wtfpl"),
    ("beerware", "licen", "beer", "(?:the )?beer ?ware licen[sc]e", "beerware"),
    ("ms-pl", "licen", "microsoft", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "licen", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("ofl", "licen", "font", "(?:sil )?open font licen[sc]e(?: (?:version )?1 [01])?", "ofl 1 [01]"),
    ("afl", "licen", "academic", "academic free licen[sc]e(?: (?:version |v )?[123] [012])?", "afl [123] [012]"),
    ("osl", "licen", "open software", "open software licen[sc]e(?: (?:version |v )?[123] [01])?", "osl [123] [01]"),
    ("odbl", "licen", "database", "open (?:data commons (?:open )?)?database licen[sc]e(?: 1 0)?", "odbl 1 0"),
    ("odc-by", "licen", "data commons", "open data commons attribution licen[sc]e(?: 1 0)?", "odc by 1 0"),
    ("pddl", "licen", "data commons", "open data commons public domain dedication and licen[sc]e", "pddl 1 0"),
    ("ncsa", "licen", "ncsa", "(?:university of illinois )?(?:uiuc )?ncsa (?:open source )?licen[sc]e", "ncsa"),
    ("bzip2", "licen", "bzip2", "bzip2 licen[sc]e", "bzip2 1 0 6"),
    ("curl", "licen", "curl", "curl licen[sc]e", "curl"),
    ("json", "licen", "json", "json licen[sc]e", "json"),
    ("qpl", "licen", "public", "q public licen[sc]e(?: 1 0)?", "qpl 1 0"),
    ("sleepycat", "licen", "sleepycat", "sleepycat licen[sc]e", "sleepycat"),
    ("vim", "licen", "vim", "vim licen[sc]e", "vim"),
    ("w3c", "licen", "w3c", "w3c (?:software (?:notice )?(?:and )?)?licen[sc]e", "w3c"),
    ("zpl", "licen", "zope", "zope public licen[sc]e(?: (?:version )?2 [01])?", "zpl 2 [01]"),
    ("upl", "licen", "permissive", "universal permissive licen[sc]e(?: (?:version |v )?1 0)?", "upl 1 0"),
    ("sspl", "licen", "server side", "server side public licen[sc]e(?: (?:version |v )?1)?", "sspl 1 0"),
    ("busl", "licen", "business", "business source licen[sc]e(?: 1 1)?", "busl 1 1"),
    ("elastic", "licen", "elastic", "elastic licen[sc]e(?: (?:version )?2(?: 0)?)?", "elastic 2 0"),
    ("cecill", "licen", "cecill", "cecill(?: (?:b|c|2 [01]))? (?:free software )?licen[sc]e", "cecill 2 [01]"),
    ("mulan", "licen", "mulan", "mulan (?:permissive software|psl) licen[sc]e(?: (?:version |v )?2)?", "mulanpsl 2 0"),
    ("hpnd", "licen", "historical", "historical permission notice and disclaimer licen[sc]e", "hpnd"),
    ("unicode", "licen", "unicode", "unicode (?:inc )?licen[sc]e(?: agreement)?", "unicode dfs 2016"),
    ("ecl", "licen", "educational", "educational community licen[sc]e(?: (?:version )?2 0)?", "ecl 2 0"),
    ("openrail", "licen", "rail", "(?:bigscience )?(?:open )?rail(?: m)? licen[sc]e", "openrail"),
    ("etalab", "licen", "etalab", "(?:etalab )?(?:open licen[sc]e|licence ouverte) etalab(?: 2 0)?", "etalab 2 0"),
    ("commons-clause", "licen", "commons clause", "commons clause licen[sc]e condition(?: 1 0)?", None),
    ("ogl", "licen", "government", "open government licen[sc]e(?: (?:version |v )?(?:[123](?: 0)?|v[123](?: 0)?))?", "ogl uk [123] 0"),
]

#: Sentences of license texts and other notices: label, priority, gate, second keyword, words.
SENTENCES = [
    ("mit", TEXT, "hereby granted", "deal", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", REFERENCE, "hereby granted", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", TEXT, "hereby granted", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", REFERENCE, "hereby granted", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd", TEXT, "redistribution", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", TEXT, "neither the name", "endorse", "neither the name of (?:the )?(?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4", TEXT, "advertising materials", "acknowledg", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", TEXT, "licen", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", TEXT, "licen", "apache", "http www apache org licenses license 2 0"),
    ("gpl", TEXT, "verbatim copies", "changing", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", NOTICE, "licen", "redistribute it", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", NOTICE, "licen", "version 2", "general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", NOTICE, "licen", "version 3", "general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl", NOTICE, "licen", "lesser", "modify it under the terms of the gnu lesser general public license"),
    ("agpl", NOTICE, "licen", "affero", "modify it under the terms of the gnu affero general public license"),
    ("mpl-2", TEXT, "licen", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", NOTICE, "licen", "accompanies", "made available under the terms of the eclipse public license (?:(?:v1 0|v 1 0|2 0) )?which accompanies this distribution"),
    ("boost", TEXT, "licen", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", TEXT, "as is without", "held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", TEXT, "public domain", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", TEXT, "neighboring rights", "waived", "has waived all copyright and related or neighboring rights"),
    ("ofl", TEXT, "licen", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("beerware", TEXT, "buy me a beer", "beer", "you can buy me a beer in return"),
    ("cc", NOTICE, "creative commons", "licen", "this work is licensed under a creative commons(?: [^ ]+){1,8} licen[sc]e"),
    ("public-domain", NOTICE, "public domain", "public domain", "(?:released into|dedicated to|placed in|in) the public domain"),
    ("proprietary", NOTICE, "all rights reserved", "all rights reserved", "(?:copyright|c) (?:c )?(?:[^ ]+ ){1,12}all rights reserved"),
    ("proprietary", TITLE, "all rights reserved", "all rights reserved", "all rights reserved"),
    ("proprietary", NOTICE, "proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", TEXT, "licen", "end user", "end user licen[sc]e agreement"),
]

GIVEN = (
    "(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered|shared|redistributed|used) under "
    "(?:(?:the )?terms (?:and conditions )?of )?(?:the |an |a )?"
)
SUBJECT = "(?:see|read|accept|subject to|governed by|agree to|accordance with|compliance with) (?:(?:the )?terms (?:and conditions )?of )?(?:the |an |a )?"


def spaced(words: str) -> str:
    """A rule over words as one over text in which every word has a space on both sides."""
    return " " + words.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?").replace("[^  ]", "[^ ]") + " "


def rules() -> list[tuple]:
    """All rules in their order: (number, label, priority, gate, second keyword, expression)."""
    listed = [(label, BASE, gate, phrase, phrase) for label, gate, phrase in PHRASES]
    listed += SENTENCES
    listed += [
        (label, TEXT, "licen", "spdx", f"spdx licen[sc]e identifier {identifier}")
        for label, _, _, _, identifier in NAMES if identifier
    ]
    for before, priority in ((GIVEN, NOTICE), (SUBJECT, REFERENCE), ("", TITLE)):
        listed += [(label, priority, gate, word, before + name) for label, gate, word, name, _ in NAMES]
    return [
        (number, label, priority, gate.replace(" ", "  "), word.replace(" ", "  "), spaced(words))
        for number, (label, priority, gate, word, words) in enumerate(listed)
    ]


RULES = rules()
_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Any rule's gate, in a text as it is written.
_GATE = "(?i)" + "|".join(sorted({gate.replace("  ", _CUT + "+") for _, _, _, gate, _, _ in RULES}))
_MARK = "\u0001"
FINDING = "array<struct<rule:int,label:string,priority:int,score:double,start:bigint,end:bigint,words:string>>"


def words_of(text: Column) -> Column:
    """The text's words in lower case, each with a space on both sides."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), _CUT + "+", " "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _places(words: Column, rule: Column) -> Column:
    """Findings of one rule. A mark is set before every match and moved to its first word, whose number is the start."""
    marked = F.regexp_replace(words, rule["expression"], F.lit(_MARK + "$0"))
    cut = F.split(F.trim(F.replace(marked, F.lit(_MARK + " "), F.lit(" " + _MARK))), "  ")
    starts = F.filter(F.transform(cut, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i)), lambda i: i.isNotNull())

    def found(matches: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            match = F.get(matches, i)
            size = F.call_function("div", F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit(""))), F.lit(2))
            return F.struct(
                rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"),
                rule["score"].alias("score"), start.cast("long").alias("start"), (start + size - 1).cast("long").alias("end"),
                F.replace(F.trim(match), F.lit("  "), F.lit(" ")).alias("words"))
        return F.transform(starts, one)

    return _let(F.regexp_extract_all(words, rule["expression"], F.lit(0)), found)


def _with_findings(texts: DataFrame) -> DataFrame:
    """(kept, text) to (kept, n, found): words and findings before suppression."""
    listed = F.array(*[
        F.struct(
            F.lit(number).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"),
            F.lit(SCORES[priority]).alias("score"), F.lit(gate).alias("gate"), F.lit(word).alias("word"),
            F.lit(expression).alias("expression"))
        for number, label, priority, gate, word, expression in RULES
    ])
    read = with_once(texts, {
        "n": F.regexp_count("text", F.lit(_WORD)).cast("long"),
        "words": F.when(F.col("text").rlike(_GATE), words_of(F.col("text"))),
    })
    words = F.col("words")
    chosen = F.filter(listed, lambda r: F.contains(words, r["gate"]) & F.contains(words, r["word"]))
    found = F.flatten(F.transform(chosen, lambda r: _places(words, r)))
    return read.select("kept", "n", F.coalesce(F.when(words.isNotNull(), found), F.array().cast(FINDING)).alias("found"))


def unsuppressed(found: DataFrame) -> DataFrame:
    """Rows (row, rule, priority, start, end, ...) that no finding of the same `row` covers and outranks."""
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for priority in (TEXT, NOTICE, REFERENCE, TITLE):
        reach = F.max(F.when(F.col("priority") == priority, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") >= priority) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return found.withColumn("_covered", covered).filter((F.col("priority") == BASE) | ~F.col("_covered")).drop("_covered")


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, findings): `docs` without their texts but with `n_words` and `row`, a number of the row, and each row's
    findings (row, rule, label, priority, score, start, end, words), suppressed ones left out."""
    kept = without(docs, [text, "n_words", "row"])
    whole = F.struct(*quoted(kept)) if kept else F.lit(None).cast("int")
    source = docs.select(whole.alias("kept"), clean_text("`" + text.replace("`", "``") + "`").alias("text"))
    read = stage(_with_findings(source).withColumn("row", F.monotonically_increasing_id()), "licenses")
    findings = read.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    texts = read.select(*(["kept.*"] if kept else []), F.col("n").alias("n_words"), "row")
    return texts, unsuppressed(findings)


def op12_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Words, base places and labels of every document."""
    texts, findings = scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.col("priority") == BASE
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    per_row = findings.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("score").alias("score"))
    return texts.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql_rules() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(
        f"({n}, {text(label)}, {p}, {SCORES[p]}, {text(gate)}, {text(word)}, {text(expression)})"
        for n, label, p, gate, word, expression in RULES)


OP12_SQL = rf"""
WITH rules(rule, label, priority, score, gate, word, expression) AS (VALUES {_sql_rules()}),
plain AS (
  SELECT doc_id, row_number() OVER () AS row,
    trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS p
  FROM documents),
worded AS (
  SELECT doc_id, row, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS n_words,
    CASE WHEN p = '' THEN '' ELSE ' ' || replace(p, ' ', '  ') || ' ' END AS words FROM plain),
matched AS (
  SELECT row, rule, label, priority, score, regexp_extract_all(words, expression) AS matches,
    string_split(trim(replace(regexp_replace(words, expression, chr(1) || '\0', 'g'), chr(1) || ' ', ' ' || chr(1)), ' '), '  ') AS cut
  FROM worded JOIN rules ON contains(words, gate) AND contains(words, word)),
placed AS (
  SELECT row, rule, label, priority, score, unnest(matches) AS match,
    unnest(list_filter(list_transform(cut, lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END), lambda i: i IS NOT NULL)) AS start
  FROM matched WHERE len(matches) > 0),
found AS (SELECT *, start + (length(match) - length(replace(match, ' ', ''))) // 2 - 1 AS stop FROM placed),
kept AS (
  SELECT * FROM found a WHERE priority = {BASE} OR NOT EXISTS (
    SELECT 1 FROM found b WHERE a.row = b.row AND b.priority >= 0 AND b.start <= a.start AND b.stop >= a.stop AND (
      b.priority < a.priority OR (b.priority = a.priority AND (b.stop - b.start > a.stop - a.start OR b.rule < a.rule)))))
SELECT any_value(doc_id) AS doc_id, any_value(n_words)::BIGINT AS n_words, count(*) FILTER (WHERE priority = {BASE}) AS n_base,
  min(start) FILTER (WHERE priority = {BASE})::BIGINT AS first_word, max(start) FILTER (WHERE priority = {BASE})::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE priority = {BASE}), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0)::DOUBLE AS score
FROM worded LEFT JOIN kept USING (row) GROUP BY row
"""

QUERIES = {"op12_license_rules": (op12_license_rules, OP12_SQL)}
