import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from corpus import frame  # noqa: E402

from thicket.llm import licenses, urlrules  # noqa: E402

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en", "block"), ("example.net", "/e", "block"), ("x.y", "", "block")]
URLS = ["http://example.net", "http://example.net/", "HTTP://EXAMPLE.Net/en/1?x=/", "https://b.a.example.net/english", "http://notexample.net/en/", "http://example.com/de", "http://example.com/de/#a", "ftp://u@h.org/fr/?", "org/fr/", None, "", "://", "http://x.y", "http://x.y?q", "a://b://c.net/d", "http://net/", "http://.net/", "http://ex\nample.net/en/\n"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(h.count("."), len(p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['', 'a.', 'www.'])}{rng.choice(['example', 'x'])}.{rng.choice(['net', 'com', 'org', 'y'])}{rng.choice(['', '/', '/en', '/en/', '/de/', '/fr/', '/e'])}{rng.choice(['', 'x', '?a', '#b'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, URLS[2], "", "")], "page_id long, url string, host string, path string")
    want = sorted(((i, *brute(u)) for i, u in [*enumerate(urls), (None, URLS[2])]), key=str)
    for got in (urlrules.judge_urls(df, RULES), urlrules.judge_urls_by_join(df, spark.createDataFrame(RULES, "host string, path string, verdict string"))):
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert urlrules.judge_urls(df.limit(0), RULES).collect() == []


def test_url_ties_and_long_ones(spark):
    """Equal rules with both verdicts, in either order; thousands of rules below one host; a very long URL."""
    rules = [("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("A.B", "/y", "block"), ("a.b", "/y", "allow"), ("a.b", "/x/deep", "allow"), *(("p.q", f"/p{k}", ("allow", "block")[k % 2]) for k in range(3000))]
    urls = ["http://a.b/x", "http://www.A.b/xx", "http://a.b/x/deeper", "http://a.b/y1", "http://p.q/p2999", "http://p.q/p1x", "http://p.q/q", "s://p.q/" + "p" * 200_000 + "/z", "http://" + "a." * 5000 + "b/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for order in (rules, rules[::-1]):
        for got in (urlrules.judge_urls(df, order), urlrules.judge_urls_by_join(df, spark.createDataFrame(order, "host string, path string, verdict string"))):
            found = [(r.rule, r.verdict) for r in got.orderBy("page_id").collect()]
            assert found == [("a.b/x", "block"), ("a.b/x", "block"), ("a.b/x/deep", "allow"), ("a.b/y", "allow"), ("p.q/p2999", "block"), ("p.q/p1", "block"), (None, "allow"), (None, "allow"), ("a.b/x", "block")]


def test_patience():
    a, b = "the quick brown fox jumps over the lazy dog".split(), "the quick red fox leaps over a lazy dog".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == ["the", "quick", "fox", "over", "lazy", "dog"]
    rng = random.Random(3)
    for _ in range(50):
        x, y = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = licenses.patience(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert licenses.patience(x, x) == [(i, i) for i in range(len(x))]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    rng = random.Random(5)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    words = mit.split()
    texts = [
        mit, filler(50) + " " + mit.upper() + " " + filler(5000), " ".join(w for i, w in enumerate(words) if i % 10), " ".join(words[: len(words) // 2]), filler(300), "", None,
        "Released under the\nMIT license!", "mit of the released " + filler(30) + " license under", "This work is licensed under the GNU General Public License, version 3. " * 2,
        licenses.TEXTS["BSD-2-Clause"], licenses.TEXTS["BSD-3-Clause"], "Licensed under CC BY-NC 4.0. " + filler(40) + " Released under the MIT License.", licenses.TEXTS["LGPL-3.0"],
    ]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, mit, None, None, None)]
    got = {}
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2), r.start_word, r.end_word))
    assert set(got) == {0, 1, 2, 7, 9, 10, 11, 12, 13}
    assert [x[:2] for k in (10, 11, 13) for x in got[k]] == [("BSD-2-Clause", 1.0), ("BSD-3-Clause", 1.0), ("LGPL-3.0", 1.0)]
    assert sorted(x[0] for x in got[12]) == ["CC-BY-NC-4.0-notice", "MIT-notice"]
    n = len(licenses.plain(mit.encode()).split())
    assert got[0] == [("MIT", 1.0, 0, n)] * 2 and got[1][0][:3] == ("MIT", 1.0, 50)
    assert got[2][0][0] == "MIT" and 0.85 < got[2][0][1] < 0.95
    assert got[7] == [("MIT-notice", 1.0, 0, 5)]
    assert [x[0] for x in got[9]] == ["GPL-3.0-notice"]


def test_no_license_is_missed_or_confused():
    """Every template is found as itself; every notice, in a text, too."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    names = list(licenses.TEMPLATES)
    for name, found in zip(names, scanner.scan([f"one two {licenses.TEMPLATES[k]} three".encode() for k in names]), strict=True):
        assert [(x[0], x[1]) for x in found] == [(name.partition("/")[0], 1.0)]


def test_no_rows(spark):
    assert licenses.scan_licenses(frame(spark, [])).collect() == []
    assert licenses.scan_licenses(frame(spark), {"none": "", "dots": "..."}).collect() == []


def test_repeated_licenses(spark):
    """Licenses that stand many times near each other, with other text around each, whole or with some words lost."""
    rng = random.Random(7)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    mit, apache = licenses.TEMPLATES["MIT"].split(), licenses.TEMPLATES["Apache-2.0"].split()
    some = lambda words: " ".join(w for w in words if rng.random() < 0.95)
    notice = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    texts = [
        " ".join(f"{filler(20)} {' '.join(mit)} {filler(20)}" for _ in range(3)), " ".join(f"{filler(40)} {some(apache)} {filler(9)}" for _ in range(6)),
        " ".join(f"{filler(3)} {notice}" for _ in range(12)), " ".join(f"{filler(9)} {' '.join(mit[:40])}" for _ in range(4)),
    ]
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert set(got) == {(0, "MIT"), (1, "Apache-2.0"), (2, "CC-BY-4.0-notice")}
    assert got[0, "MIT"][2:] == (1.0, 20, 20 + len(licenses.plain(" ".join(mit).encode()).split())) and got[1, "Apache-2.0"].coverage >= 0.85
    assert got[2, "CC-BY-4.0-notice"][2:] == (1.0, 6, 3 + len(licenses.plain(notice.encode()).split()))


def test_common():
    """Against the usual table, and without an anchor on more than 64 words a side."""
    rng = random.Random(11)
    for n in [5, 20, 150] * 10:
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, n))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        got = licenses._common(x, y, 0, 0)
        assert len(got) == best[-1][-1] == licenses._common_length(x, licenses._masks(y), len(y))
        assert all(x[i] == y[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert len(licenses.patience("ab" * 50 + "c", "d" + "ba" * 50)) == 99
