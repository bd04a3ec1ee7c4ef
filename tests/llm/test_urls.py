import random
import re

from pulsewright.llm import urls


def as_regex(glob):
    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return re.compile(out.encode(), re.S)


def test_automaton_matches_as_regular_expressions_do():
    rng = random.Random(6)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 30))]
        texts = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(14))).encode() for _ in range(50)]
        got = urls.WildcardSet(globs).match(texts)
        for text, row in zip(texts, got, strict=True):
            assert row.tolist() == [as_regex(g).fullmatch(text) is not None for g in globs]


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://EXAMPLE.org/en/12?x=1"), (2, "https://a.example.org/es/"), (3, "https://b.org/x"), (4, "http://x.com/fr/1#a"), (5, "http://x.com/de/1"),
        (6, "http://spam-farm.net/x"), (7, "http://ok.net/x"), (8, None), (9, "no scheme"), (10, "http://org"), (11, "http://evil.net/a.org/b"), (12, "x://notexample.org/en/1"), (12, "x://notexample.org/en/1"), (13, "http://h/" + "a" * 20000), (14, ""),
    ]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect()}
    say = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert say[1] == ("example.org", "/en/12", "example.org/en/1", "block") and say[2] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert say[3] == ("b.org", "/x", "org/", "allow") and say[4] == ("x.com", "/fr/1", "com/fr/", "allow") and say[5] == ("x.com", "/de/1", "com/de/", "block")
    assert say[6] == ("spam-farm.net", "/x", None, "block") and say[7] == ("ok.net", "/x", None, "allow")
    assert say[8] == say[9] == say[14] == ("", "", None, "allow") and say[10] == ("org", "", None, "allow")
    assert say[11][2:] == (None, "allow") and say[12] == ("notexample.org", "/en/1", "org/", "allow")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
