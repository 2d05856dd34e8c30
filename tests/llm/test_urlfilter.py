import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import urlfilter as U

URLS = [
    "http://A.example.org/en/12?x=1", "https://example.org/es/9", "https://m.example.org/es", "http://example.org/en/2", "http://x.com/fr/8", "http://x.com/de/8#top",
    "http://x.com/en/8?page=2", "http://x.net/ads/1.gif", "http://ads.x.net/", "http://x.net/add/1", "http://x.net/tracking?utm_source=a", "http://org", "http://org/", None, "", "no scheme/ads/",
    "http://notorg/a", "ftp://x.net?a", "http://x.net/a\nb?c=1", "http://x.net/login", "http://x.net/loginx", "http://x.net/wp-admin/", "http://x.net/archive/2020/", "http://x.net/?jsessionid=1", "a://b://c/d",
    "http://x.com/de/" + "a" * 50_000, "http://x.net/trackers?banner=1",
]


def brute(url):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[: cut.start()] if cut else rest)
        tail = rest[cut.start() :] if cut else ""
        path = re.split(r"[?#]", tail, maxsplit=1)[0]
    best = None
    for rule, verdict in U.HOST_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    hit = any(re.search(p, u.lower()) for p in U.PATTERNS)
    return host, path, best[0] if best else None, best[1] if best else ("block" if hit else "allow")


def test_verdicts_equal_running_every_rule(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[0], "")], "page_id bigint, url string, pattern string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    assert got.pop(None) == brute(URLS[0])
    for i, u in enumerate(URLS):
        assert got[i] == brute(u), u


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a/x?page=1",)] * 3 + [("http://wp-admin/",)], "url string")
    index, rest = U.rule_index(df, (r"/wp-admin/", r"[?&]page=[0-9]+", r"x.*y"))
    assert rest == ["x.*y"] and index["page"] == [r"[?&]page=[0-9]+"] and ("wp" in index) != ("admin" in index)


def test_required_tokens_are_whole_tokens():
    need = lambda p: set(U.required_tokens(p).needs)
    assert need(r"[/.]ads?[/.]") == {("ad",), ("ads",)}
    assert need(r"[?&]utm_[a-z]+=") == {("utm",)}
    assert need(r"abc") == need(r"/abc") == need(r"/a.c/") == need(r"/(a|.*)/") == set() and need(r"/abc/") == {("abc",)}
    assert need(r"/(cart|checkout)([/?#]|$)") == {("cart",), ("checkout",)}
    assert need(r"/foo/|/bar/") == {("foo",), ("bar",)}
    assert need(r"/ads.js/") == set() and need(r"/foo[^/]+/bar/") == {("bar",)}


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_a_match_has_the_tokens(data):
    piece = st.sampled_from(["a", "b", "ab", "1", "/", r"\.", "_", "[/?]", "[ab]", "[^/]", ".", r"\d", r"\b", "^", "$", r"\W", "-"])
    many = st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,2}"])
    unit = st.tuples(piece, many).map(lambda x: x[0] + (x[1] if x[0] not in ("^", "$", r"\b") else ""))
    flat = st.lists(unit, min_size=1, max_size=5).map("".join)
    group = st.tuples(st.lists(flat, min_size=1, max_size=3), many).map(lambda x: "(" + "|".join(x[0]) + ")" + x[1])
    pattern = "".join(data.draw(st.lists(st.one_of(flat, group), min_size=1, max_size=4)))
    text = data.draw(st.text("ab1/._-?", max_size=14))
    needs = U.required_tokens(pattern).needs
    if needs and re.search(pattern, text):
        tokens = set(re.findall("[a-z0-9]+", text))
        assert any(set(x) <= tokens for x in needs)


def test_ten_thousand_rules_equal_running_each(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(2, 6)))
    shapes = [lambda: f"/{word()}/", lambda: f"/({word()}|{word()}s?)[/.]", lambda: f"[?&]{word()}=[0-9]+", lambda: f"/{word()}/|[.]{word()}$", lambda: f"/{word()}[^/]+/{word()}/"]
    rules = [r.choice(shapes)() for _ in range(10_000)]
    urls = [f"http://{word()}.com/{word()}/{word()}.{word()}/?{word()}={r.randrange(9)}" for _ in range(300)]
    got = {x.url: x.pattern for x in U.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), (), rules).collect()}
    run = sorted({(p, re.compile(p)) for p in set(rules)}, key=lambda x: x[0])
    for u in urls:
        assert got[u] == next((p for p, c in run if c.search(u)), None), u


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_columns_of_any_names_stay(spark):
    from fabula.llm.urlfilter import judge_urls

    df = spark.createDataFrame([(1, "http://a.org/x", "mine", "p", "u", "h")], "page_id bigint, link string, _fit string, page string, url string, host string")
    got = judge_urls(df, url="link").first().asDict()
    assert {k: got[k] for k in ("page_id", "link", "_fit", "page", "url")} == {"page_id": 1, "link": "http://a.org/x", "_fit": "mine", "page": "p", "url": "u"}
    assert got["host"] == "a.org" and got["path"] == "/x" and got["verdict"] == "allow"
