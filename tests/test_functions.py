"""Golden values of the text, URL, label and HTML functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from brightvane.functions import html, labels, text, urls
from brightvane.operators import extraction


def values(spark, rows, *columns):
    """Columns over a one-column table x."""
    return [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "x string").select(*columns).collect()]


X = F.col("x")


def test_clean_and_count(spark):
    got = values(spark, ["  a line here \r\nok\n\n\n\n\nnext\t\ttab  ", None, "ﬁne  "], text.clean_text(X), text.word_count(X))
    assert got == [("a line here\n\nnext tab", 6), ("", 0), ("fine", 1)]


def test_sentences_and_truncate(spark):
    got = values(spark, ["First one. Second here! no split. “Quoted” one?"], text.sentences(X), text.truncate(X, 12))
    assert got == [(["First one.", "Second here! no split.", "“Quoted” one?"], "First one. …")]


def test_hashes_ignore_format(spark):
    got = values(spark, ["The “Quick” fox — Privacy Policy", 'the "quick"  FOX -', ""], text.normalize_for_hash(X), text.content_hash(X))
    assert got[0] == got[1] and got[0][0] == "the quick fox" and len(got[2][1]) == 64


def test_shingles_and_jaccard(spark):
    a = "a b c d e f"
    got = values(spark, [a, "a b", ""], F.size(text.shingles(X)), text.jaccard(text.shingles(X, compose=False), text.shingles(F.lit(a), compose=False)))
    assert got == [(2, 1.0), (1, 0.0), (0, 0.0)]


def test_slugify(spark):
    assert values(spark, ["Héllo,  World_again!", "", "---"], text.slugify(X)) == [("hello-world-again",), ("untitled",), ("untitled",)]


def test_verbatim_gate(spark):
    source = F.lit("He said “we lost   forty calls” that week.")
    assert values(spark, ['we lost forty calls', "we lost fifty calls", "short", None], text.is_verbatim(X, source)) == [(True,), (False,), (False,), (False,)]


def test_quotes_and_numbers(spark):
    sample = 'The owner said "we answered every single call within five minutes" to Jane Roe. Revenue in the region grew by 38% over the last year, they told us. In 2024 there were 5 people here in this room.'
    quotes, claims = values(spark, [sample], text.extract_quotes(X), text.extract_numerical_claims(X, compose=False))[0]
    assert [q.quote for q in quotes] == ["we answered every single call within five minutes"] and quotes[0].verified_verbatim
    assert sample[quotes[0].char_start : quotes[0].char_end] == quotes[0].quote
    assert [c.value for c in claims] == ["38%"]


def test_prose(spark):
    rows = ["The company lost many calls because nobody was there to answer them.", "Watch a demo of the platform that helps you and your team today.", "Home Services And Automotive Retail", "Gfh ifkgzgg hcfapv rmr rukbtc ahb phehadg bcd qrst."]
    assert values(spark, rows, text.looks_like_prose(X)) == [(True,), (False,), (False,), (False,)]


def test_ends_are_stripped_of_any_blank(spark):
    raw = ["\u3000\u2003 a b c \x85\t", " \u200a ", "\n\x0b\x0c one\u2028\n two\u1680 \n", "€ x €", "ab ", "", " "]
    lines = [[x.strip() for x in t.split("\n")] for t in raw]
    want = ["\n".join(x for x in t if x == "" or len(x) > 2).strip() for t in lines]
    assert values(spark, raw, text.clean_text(X, False)) == [(t,) for t in want]


def test_promotional_and_evidence(spark):
    assert values(spark, ["Request a demo now", "nothing"], text.looks_promotional(X)) == [(True,), (False,)]
    body = "The front desk missed every third call in the week that we looked at it. Nothing of note was said about the weather on that day, they told us."
    got = values(spark, [body], text.select_evidence_passages(X, ["call"], priority=["missed"], compose=False))[0][0]
    assert [p.passage for p in got] == ["The front desk missed every third call in the week that we looked at it."]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://www.Example.com:80/a/index.html?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2"), ("example.com", "https://example.com/"), ("//example.com/x/", "https://example.com/x"), ("https://e.com:8443/?q=a b&empty=", "https://e.com:8443/?q=a+b"),
    ("ftp://e.com/x", "ftp://e.com/x"), ("", ""), (None, ""), ("https://e.com/?q=~*", "https://e.com/?q=~%2A"), ("https://e.com/?REF=z&p=3", "https://e.com/?p=3"),
])
def test_normalize_url(spark, url, want):
    assert values(spark, [url], urls.normalize_url(X)) == [(want,)]


def test_domains(spark):
    rows = ["https://www.a.co.uk/x", "http://u:p@b.c.example.com:81/", "plain.org/x", None]
    assert values(spark, rows, urls.domain_of(X), urls.registrable_domain(X)) == [("a.co.uk", "a.co.uk"), ("b.c.example.com", "example.com"), ("plain.org", "plain.org"), ("", "")]
    assert values(spark, ["https://x.allowed.com", "https://notallowed.com", "https://bad.allowed.com"], urls.is_allowed(X, ("allowed.com",), ("bad.allowed.com",))) == [(True,), (False,), (False,)]
    assert values(spark, ["mailto:a@b.c", "https://a", "a.com", "/x", ""], urls.is_http_url(X)) == [(False,), (True,), (True,), (False,), (False,)]


def test_video_ids(spark):
    rows = ["https://youtu.be/abc?t=1", "https://www.youtube.com/watch?v=def&x=1", "https://youtube.com/shorts/ghi/", "https://e.com/watch?v=1"]
    assert values(spark, rows, urls.video_id(X)) == [("abc",), ("def",), ("ghi",), (None,)]


def test_labels(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = X.cast("timestamp")
    rows = ["2024-01-30 23:30:00", "2024-01-30 20:00:00", "2024-01-20 00:00:00", "2023-10-01 00:00:00", "2021-01-01 00:00:00", None]
    assert [r[0] for r in values(spark, rows, labels.relative_time(at, now))] == ["30 mins ago", "4 hours ago", "11 days ago", "4 months ago", "3 years ago", "no date"]
    assert values(spark, ["x"], labels.growth_phrase(F.lit(3), F.lit(0)), labels.growth_phrase(F.lit(3), F.lit(2)), labels.count_label(F.lit(1200), "source")) == [("new this period — 3 sources, none previously", "up 50% — 3 this period vs 2 last", "1,200 sources")]


def test_html(spark):
    page = """<html lang="en"><head><title>Old</title><meta property="og:title" content="Right title"><link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","author":{"name":"A B"},"datePublished":"2024-01-02"}]}</script></head>
    <body><nav><p>menu words that go away now</p></nav><p>outside of the article are words</p><article><h1>A heading of four words</h1><p>The body stands <b>here in</b> full.</p><p>The body stands here in full.</p><a href="/next?utm_source=x">n</a><a href="mailto:x@y">m</a></article></body></html>"""
    a, links = values(spark, [page], html.parse_html(X), html.page_links(html.parse_html(X)["links"], F.lit("https://e.com/p")))[0]
    assert (a.title, a.author, a.published, a.lang, a.body) == ("Right title", "A B", "2024-01-02", "en", "A heading of four words\n\nThe body stands here in full.")
    assert links == ["https://e.com/next"]
    assert [str(r[0])[:10] for r in values(spark, ["2024-01-02", "Tue, 02 Jan 2024 10:00:00 GMT", "1990-01-01", "x"], html.parse_date(X, 2025))] == ["2024-01-02", "2024-01-02", "None", "None"]


def test_doubles_are_rounded_as_in_sql(spark):
    """h04, m06, g01: a double a little under or over a tie goes where SQL engines put it; scores of extraction always go up."""
    x = F.col("x")
    rows = spark.createDataFrame([(0.575, 61.349999999999994), (0.125, 61.35), (-0.125, 0.25), (None, None)], "x double, y double")
    assert [tuple(r) for r in rows.select(text.rounded(x, 2), text.rounded(F.col("y"), 1)).collect()] == [(0.57, 61.4), (0.13, 61.4), (-0.13, 0.3), (None, None)]
    one = spark.range(1).select(F.lit(1.1499999999999999 + 0.365).alias("s"), F.lit(1.5149999999999997).alias("t"))
    assert tuple(one.select(extraction._score(F.col("s")), extraction._score(F.col("t"))).first()) == (1.52, 1.52)


def test_only_what_composition_changes_goes_to_python(spark, monkeypatch):
    """b01, b07: NFKC of texts of many scripts equals Python's, and of usual accented text nothing reaches Python."""
    rows = ["é ß ’ Ю 中 한", "été", "ﬁ①Ａ", "a b…", "́x", "한ᆨ 각", "q̣̇ q̣̇", "x²\n½\U0001d400\U0001f600y", "がｶﾞ", "e" + "̣́" * 3000 + "z", "", None, "ǆ ſt à"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(text.nfkc(X)).collect()]
    assert got == [unicodedata.normalize("NFKC", r or "") for r in rows]
    for block in (range(0, 0x3400), range(0xA640, 0xABFF), range(0xF900, 0x10000), range(0x1D400, 0x1D800)):
        chars = [f"a{chr(c)}o" for c in block if not 0xD800 <= c < 0xE000]
        assert [r[0] for r in spark.createDataFrame([(r,) for r in chars], "x string").select(text.nfkc(X)).collect()] == [unicodedata.normalize("NFKC", r) for r in chars]
    asked = spark.createDataFrame([("Größe, naïve “Élan” – Ñandú",)], "x string").select(X.rlike(text._UNSTABLE)).first()
    assert not asked[0]


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_judged_only_where_they_matter(spark):
    """B-16, B-19: the text is composed once, and only sentences that can give something are judged."""
    long = "The 45% of leads that we saw in March came from calls. " + "And the rest of them came from walk-ins in the shop. " * 3 + "ﬁne ＷＯＲＤＳ are here and there and in the end too."
    rows = [long, "", None, "No figures in this one, but it is long enough to be prose.", "Grew by 1,250 customers, the shop says, and by 30 calls a day.\nAnd the ２５０ leads of it are the most that it had."]
    got = values(spark, rows, text.extract_numerical_claims(X), text.select_evidence_passages(X, ["the"], priority=["shop"]))
    assert [[c["value"] for c in r[0]] for r in got] == [["45%"], [], [], [], ["1,250 customers", "30 calls", "250 leads"]]
    assert all(c["verified_verbatim"] for r in got for c in r[0])
    assert [[p["passage"][:9] for p in r[1]] for r in got] == [["And the r", "And the r", "The 45% o"], [], [], [], ["Grew by 1", "And the 2"]]
    x = spark.createDataFrame([("a",)], "x string")
    for c in (text.extract_numerical_claims(X), text.select_evidence_passages(X, ["the"])):
        assert planned(x.select(c)).count("CASE WHEN isnotnull(pythonUDF0") == 1


def test_words_of_prose_are_cut_once(spark):
    """B-18: what a caller has at hand gives the same."""
    rows = ["THE BIG SALE is on in the shop and you are all here.", "The shop that we saw in March is the one with the calls.", "Brw xkc pqrs tvw zzx klm nnp qqr sst wwx.", "ẞIG ŉews AND “the” Σας of the ΣΑΣ, you and we are in it.", "short", "", None]
    w = text.words(X)
    got = values(spark, rows, text.looks_like_prose(X), text.looks_like_prose(X, w, text.looks_like_gibberish(X, w)), text.looks_like_gibberish(X), text.looks_like_gibberish(X, w))
    assert [r[0] for r in got] == [r[1] for r in got] and [r[2] for r in got] == [r[3] for r in got]
    assert [r[2] for r in got] == [False, False, True, True, False, False, False]
    assert [r[0] for r in got][:3] == [False, True, False]
