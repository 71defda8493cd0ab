import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from noonward.llm import url_filter as uf

text = st.text(alphabet="ab./?*", max_size=8)


def as_regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=6), st.lists(text, max_size=5))
def test_as_regular_expressions(globs, texts):
    found = uf.Automaton(globs).matches(texts)
    assert found.tolist() == [[bool(as_regex(g).fullmatch(t)) for g in globs] for t in texts]


def test_globs_over_many_words():
    globs = ["a" * 70 + "*" + "b" * 70, "*" + "c" * 130, "x?z"]
    texts = ["a" * 70 + "?" + "b" * 70, "a" * 140, "d" + "c" * 130, "xyz", "x" * 20_000, ""]
    assert uf.Automaton(globs).matches(texts).tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


RULES = [
    *uf.prefix_rules("org", "/", "allow"),
    *uf.prefix_rules("example.org", "/es/", "block"),
    uf.Rule("*bad*#*", "block"),
]


def judged(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = sorted(uf.judge(df, RULES).collect())
    return [(r.host, r.path, r.rule, r.verdict) for r in rows]


def test_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "http://example.org/es", "http://badexample.org",
        "http://x.com/www.org/", "ftp://notorg/", "http://bad.com?x=/", "http://h#/p", "a://b://c/d", "://org/x",
    ]
    assert judged(spark, urls) == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/es", "org/", "allow"),
        ("badexample.org", "", None, "block"),
        ("x.com", "/www.org/", None, "allow"),
        ("notorg", "/", None, "allow"),
        ("bad.com", "", None, "block"),
        ("h", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
        ("org", "/x", "org/", "allow"),
    ]


def test_empty_table_clashing_names_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(df, RULES).count() == 0
    df = spark.createDataFrame([(1, "http://a.org/", "x", "y"), (1, "http://a.org/", "x", "y")], "page_id long, url string, Host string, verdict string")
    rows = uf.judge(df, RULES).collect()
    assert [r.asDict() for r in rows] == [dict(page_id=1, url="http://a.org/", host="a.org", path="/", rule="org/", verdict="allow")] * 2
    assert {r.verdict for r in uf.judge(df, []).collect()} == {"allow"}
