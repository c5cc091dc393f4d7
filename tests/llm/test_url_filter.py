import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgraph.llm import url_filter as uf

SCHEMA = "page_id long, url string"


def by_regex(glob, text):
    out = b""
    for s in uf.symbols(glob):
        out += {"*": b"[^/]*", "**": b".*", "?": b"[^/]"}[s] if isinstance(s, str) else re.escape(bytes([s]))
    return re.fullmatch(out, text, re.DOTALL) is not None


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(alphabet="ab/*?\\é.", max_size=30), min_size=1, max_size=12),
    st.lists(st.text(alphabet="ab/é.\n", max_size=90), max_size=12),
)
def test_automaton_against_regular_expressions(globs, texts):
    texts = [t.encode() for t in texts]
    got = uf.Automaton(globs).match(texts)
    assert got.shape == (len(texts), len(globs))
    for i, t in enumerate(texts):
        assert [bool(g) for g in got[i]] == [by_regex(g, t) for g in globs]


def test_rules_longer_than_a_word():
    long = "x" * 200 + "*" + "y" * 130
    got = uf.Automaton(["a*", long, "b"]).match([b"x" * 200 + b"zz" + b"y" * 130, b"b", b"x" * 200])
    assert got.tolist() == [[False, True, False], [False, False, True], [False, False, False]]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://www.example.org/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/ES/", "example.org", "/ES/", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://a.com/en/x.org/", "a.com", "/en/x.org/", None, "allow"),
    ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"),
    ("http://spam-farm.net?x", "spam-farm.net", "", None, "block"),
    ("http://a.net/x/get.exe", "a.net", "/x/get.exe", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("a://b://c", "b:", "//c", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_verdicts(spark, url, host, path, rule, verdict):
    out = uf.judge_urls(spark.createDataFrame([(1, url)] * 2, SCHEMA)).collect()
    assert [tuple(r)[2:] for r in out] == [(host, path, rule, verdict)] * 2


def test_own_rules_empty_table_clashes_and_long_urls(spark):
    sites = [uf.Site("a*b", "/?", "block")]
    df = spark.createDataFrame([(None, "x://A*b/?", "mine"), (2, "x://a*b/" + "?", "mine"), (3, "x://axb/?", "m")],
                               SCHEMA + ", verdict string")
    out = uf.judge_urls(df, sites=sites, block_globs=[])
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.verdict for r in out.collect()} == {"allow"}
    assert uf.judge_urls(df.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "x://h.org/" + "é/" * 50000 + "z.exe")], SCHEMA)
    assert uf.judge_urls(long, sites=[]).first().verdict == "block"
