"""Operator 5 against plain parsing, and the model on names it was not trained on."""

import re

from folioscope.llm import op5_urls as op5
from tests.llm import corpus

URLS = [
    "http://a.example.com/en/1", "https://www.Example.COM/en/x?y#z", "http://example.com/en/",
    "http://example.com/en", "http://xexample.com/en/1", "http://b.www.example.com/en/2",
    "http://com/", "http://com", "HTTP://x.net/es/1", "x.net/es/1", "http://x.net/fr/2#/es/",
    "http://x.net?/fr/", "://y.net/fr/", "http://ÉX.com/", "http://a://b.net/es/", None, "", "://",
    "http://x.org/\nb", "http://best-casino-win.org/en/12", "http://quietlibrary.org/en/12",
    "http://x.com./", "mailto:me", "http://x.net/es", "http:///net/es/",
]


def plain(url):
    host, path, rest = "", "", (url or "").partition("://")
    if rest[1]:
        host = re.match("[^/?#]*", rest[2])[0]
        path = re.match("[^?#]*", rest[2][len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in op5.RULES:
        top, _, below = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith("/" + below):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_rules_and_model(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[0]), (0, URLS[0])]
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in rows],
                                  "page_id long, url string, html string, score string")
    model = op5.train(op5.labelled_urls(spark))
    got = op5.judge(pages, model)
    want = sorted(((i, *plain(u)[:3]) for i, u in rows), key=repr)
    assert corpus.bag(got, "page_id", "host", "path", "rule") == want
    for row in got.collect():
        expected = plain(URLS[row.page_id or 0])[3]
        assert row.verdict == (expected or ("block" if row.score >= 0.5 else "allow"))
    by_host = {r.host: r.verdict for r in got.collect()}
    assert by_host["best-casino-win.org"] == "block"
    assert by_host["quietlibrary.org"] == "allow"
    assert op5.judge(pages.limit(0), model).count() == 0


# Names put together without the labelled table; a few of their words stand in it.
UNSEEN = {
    "allow": """cookery botanical-society stamp-collectors opera-house allotments marine-research
        mapmakers dictionary translators veterinary kindergarten planetarium bookbinding
        folkdance beekeepers rowingclub quilting genealogy woodlandtrust town-hall""".split(),
    "block": """payday-credit quick-cash-now hot-girls-tonight online-bets megajackpot
        discount-meds lose-weight-fast make-money-home watches-replicas sexchat strip-webcam
        crackedsoftware instantloan luckyspin blackjack-vip nudegirls herbal-enhancer
        get-rich-quick secure-account-update earn-from-home""".split(),
}


def test_the_table_is_balanced_and_unseen_names_are_told(spark):
    assert {len(w) for w in op5.WORDS.values()} == {80}
    assert not set(op5.WORDS[0]) & set(op5.WORDS[1])
    rows = [(name, verdict, f"https://{name}.info/a/b") for verdict, names in UNSEEN.items()
            for name in names]
    pages = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)],
                                  "page_id long, url string")
    got = {r.page_id: r.verdict for r in op5.judge(
        pages, op5.train(op5.labelled_urls(spark))).collect()}
    wrong = [r[:2] for i, r in enumerate(rows) if got[i] != r[1]]
    # Measured: 1 clean and 8 other names of 40. Names of unknown words only are mostly allowed.
    assert len(wrong) <= 0.25 * len(rows), wrong
    assert sum(verdict == "allow" for _, verdict in wrong) <= 2, wrong
