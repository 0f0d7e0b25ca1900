"""Wildcards within a rule beside regular expressions."""

import itertools
import re

from geomosaic.llm import url_filter


def regex(glob):
    out, path = "", False
    for at, c in enumerate(glob):
        path |= c == "/"
        out += (".*" if path or at == len(glob) - 1 else "[^/]*") if c == "*" else ("." if path else "[^/]") if c == "?" else re.escape(c)
    return re.compile(out, re.S)


def test_inner_wildcards():
    globs = ["*.ads*.example.org/*", "*.example.org/*/print*", "*.a*b*/c*d", "*.**x/*", "a*b", "*.a*a/*", "*." + "long" * 20 + "*.org/*", "*.org/*"]
    rows = ["", ".ads.example.org/", ".ads7.example.org/x", ".my.ads-1.b.example.org/", ".ads/.example.org/", ".example.org/a/b/print", ".example.org/print", ".x.example.org//print/1", f".{'long' * 20}er.org/", f".{'long' * 19}.org/"]
    rows += ["".join(x) for n in (2, 3, 4, 5) for x in itertools.product(".ab/", repeat=n)] + [".a1b2/c3/d", ".a1b2/c3/de", ".ab/cd", ".a/b/cd", ".a.x/", ".x/"]
    got = url_filter.ShiftAnd([g.encode() for g in globs]).match([r.encode() for r in rows])
    want = [[bool(regex(g).fullmatch(r)) for g in globs] for r in rows]
    assert got.tolist() == want
    assert all(any(w[i] for w in want) for i in range(len(globs)))


def test_a_rule_with_an_inner_wildcard_judges(spark):
    pages = spark.createDataFrame([(1, "http://ads3.example.org/x"), (2, "http://example.org/x"), (3, "http://example.org/a/print")], "page_id long, url string")
    rules = [url_filter.Rule("block", "ads*.example.org/"), url_filter.Rule("block", "example.org/*/print")]
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_patterns_do_not_run_into_each_other():
    got = url_filter.ShiftAnd([b"ab*", b"cd*", b"d/*", b"*c"]).match([b"abcd", b"cdd/", b"abc", b"/d/", b"c"])
    assert got.tolist() == [[True, False, False, False], [False, True, False, False], [True, False, False, True], [False, False, False, False], [False, False, False, True]]


def test_single_byte_wildcards_and_many_words(monkeypatch):
    globs = ["a?c*", "*.x?/?b", "????", "*/?", "a?/*", *[f"{c}{d}?{c}*" for c in "abx" for d in "ab/."] * 6]
    rows = ["".join(x) for n in (1, 3, 4, 5) for x in itertools.product("ab/.x", repeat=n)]
    automaton = url_filter.ShiftAnd([g.encode() for g in globs])
    assert automaton.words > 1
    want = [[bool(regex(g).fullmatch(r)) for g in globs] for r in rows]
    # a wildcard in front stays within the host
    for i, g in enumerate(globs):
        if g.startswith("*"):
            for w, r in zip(want, rows):
                w[i] = any(regex(g[1:]).fullmatch(r[k:]) and "/" not in r[:k] for k in range(len(r) + 1))
    assert automaton.match([r.encode() for r in rows]).tolist() == want
    monkeypatch.setattr(url_filter, "LONG", 0)
    assert automaton.match([r.encode() for r in rows]).tolist() == want


def test_long_urls_null_ids_and_repeats(spark):
    long = "http://a.example.org/en/" + "x/" * 300_000
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://x.com/de/a"), (2, "http://" + "a." * 3000 + "com/de/"), (3, None)], "page_id long, url string")
    rules = [url_filter.Rule("block", "example.org/en/"), url_filter.Rule("block", "com/de/")]
    got = sorted((str(r["page_id"]), r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert got == [("1", "block"), ("1", "block"), ("2", "block"), ("3", "allow"), ("None", "block")]
