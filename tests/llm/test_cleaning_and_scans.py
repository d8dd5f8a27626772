"""Toxicity, personal data, page text and secrets on small fixtures."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import html_extract, pii, secret_scan, toxicity

SMALL = "/root/testdata/sf0.01"


def texts(spark, values, ids=None):
    rows = [(i, t, "clash") for i, t in zip(ids or range(len(values)), values)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)


# --- toxicity


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert not any(p and not t for p, t in held)


def toxic_fixture(spark):
    rnd = random.Random(6)
    fill = lambda: " ".join(rnd.choice("stone river cloud table garden window paper music".split()) for _ in range(8))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "muslim" if toxic and rnd.random() < 0.9 or not toxic and rnd.random() < 0.02 else ""
        rows.append((i, f"{fill()} {group} {'vermin' if toxic and rnd.random() < 0.6 else ''} {fill()}"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactuals_keep_neutral_mentions_down(spark):
    docs, labels = toxic_fixture(spark)
    neutral, insult = "a muslim neighbour in the garden", "vermin near the river"
    plain = toxicity.Scorer(toxicity.train(docs, labels, counterfactual=0.0))
    fair = toxicity.Scorer(toxicity.train(docs, labels, counterfactual=5.0))
    assert plain.score(neutral) > 0.5 > fair.score(neutral)
    assert fair.score(insult) > 0.5
    gap = lambda s: abs(s.score(neutral) - s.score(neutral.replace("muslim", "christian")))
    assert gap(fair) < gap(plain) / 3


def test_toxicity_cases(spark):
    docs, labels = toxic_fixture(spark)
    weights = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "vermin " * 50_000, 9.0)], "doc_id long, text string, score double")
    got = toxicity.scored(odd, weights).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "score"]
    assert got[0].score == got[1].score < 0.5 < got[2].score
    nobody = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.scored(docs, nobody).collect())
    mixed = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")).union(labels)
    assert toxicity.train(docs, mixed) == pytest.approx(weights)
    assert toxicity.kept_documents(docs.limit(0), labels).count() == 0
    assert toxicity.swapped("Muslim women") == "christian men" and toxicity.swapped("stones") is None


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_pii(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(number) <= 19 and luhn(number),
                "phone": 10 <= len(number) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return [sum(f[3] == k for f in found) for k in BASE], hashlib.sha256(listed.encode()).hexdigest()


def pii_texts():
    rnd = random.Random(11)
    parts = ["a@b.c", "_x@y.zz", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+49 30 1234567", "+1", " ", "é", "😀", "-", ".", "7", "12", "x"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(300)]
    return values + [None, "", "a" * 30_000 + "@x.y", "1" * 30_000, "1 23-" * 8000, "n@m.de " * 700]


def run_pii(spark, df, monkeypatch):
    monkeypatch.setattr(pii, "table", lambda *a: df)
    return {r.doc_id: r for r in pii.op7_pii(spark, SMALL).collect()}


def test_base_spans_match_brute_force(spark, monkeypatch):
    values = pii_texts()
    got = run_pii(spark, texts(spark, values), monkeypatch)
    for i, text in enumerate(values):
        r = got[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute_pii(text), text[:80]


def test_contexts_find_unseen_identifiers(spark, monkeypatch):
    values = [f"é Kontakt: n{i}@m{i}.de ok" for i in range(7)] + ["see Kontakt: root@intranet. and", "other: root@intranet", "Kontakt: keine"]
    got = run_pii(spark, texts(spark, values), monkeypatch)
    assert got[7].spans == "email:13:26" and got[7].n_email == 0
    assert got[8].spans == got[9].spans == ""
    few = run_pii(spark, texts(spark, values[4:]), monkeypatch)
    assert few[3].spans == ""


def test_contexts_find_identifiers_of_several_words(spark, monkeypatch):
    values = [f"call Phone: +1 ({740 + i}) 555-38{i:02} today" for i in range(7)]
    values += ["see Phone: (743) 555-3824 now", "Phone: 0171 234 5678, soon", "room 0171 234 5678 b"]
    cards = [4716 * 10**12 + i for i in range(10_000) if luhn(str(4716 * 10**12 + i))][:6]
    grouped = lambda n: " ".join(str(n)[i : i + 4] for i in range(0, 16, 4))
    values += [f"é pay Card: {grouped(n)} please" for n in cards] + ["pay Card: 4716 0000 0000 9999 999 then"]
    values += [f"Card: {grouped(cards[0])} (12345) x", "Phone: " + "1234 5678 " * 6 + "end"]
    got = run_pii(spark, texts(spark, values), monkeypatch)
    assert got[0].spans == "phone:12:29" and got[0].n_phone == 1
    assert got[7].spans == "phone:11:25" and got[8].spans == "phone:7:20" and got[9].spans == ""
    assert got[16].spans == "card:10:33" and got[16].n_card == 0
    assert got[17].spans == "card:6:25"
    assert got[18].spans == "phone:7:11"


def test_pii_repeats_null_ids_and_nothing(spark, monkeypatch):
    df = texts(spark, ["a@b.c", "a@b.c", "a@b.c"], [1, 1, None])
    monkeypatch.setattr(pii, "table", lambda *a: df)
    assert [r.spans for r in pii.op7_pii(spark, SMALL).collect()] == ["email:0:5"] * 3
    assert pii.extract(df.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    docs = texts(spark, ["token = abcdefgh", "a@b.c"])
    for frame in (secret_scan.secrets(docs), pii.extract(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- secrets


def brute_secrets(text):
    text, found = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")], hashlib.sha256(listed.encode()).hexdigest()


def test_secrets_match_brute_force(spark):
    rnd = random.Random(12)
    parts = ["token", "PassWord", "api_key", "apikey", "=", ": ", " ", '"', "abc", "1234567", "AKIA", "ABCDEFGH12345678", "é", "😀", "0123456789abcdef", "k"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(400)]
    values += [None, "", "secret: 123456 " * 700, "x" * 60_000 + "deadbeef" * 5, "ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----"]
    got = {r.doc_id: r for r in secret_scan.secrets(texts(spark, values)).collect()}
    for i, text in enumerate(values):
        r = got[i]
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute_secrets(text), text
    assert got[404].spans == "github:0:44" and got[405].spans == "private_key:0:31"


def test_secrets_repeats_and_nothing(spark):
    df = texts(spark, ["token=abcdef", "token=abcdef", None], [1, 1, None])
    assert sorted(r.spans for r in secret_scan.secrets(df).collect()) == ["", "assign:0:12", "assign:0:12"]
    assert secret_scan.secrets(df.limit(0)).count() == 0


def holds(query, text):
    kind, trigrams, queries = query
    terms = [t in text for t in trigrams] + [holds(q, text) for q in queries]
    return all(terms) if kind == "and" else any(terms)


def test_trigram_queries_hold_for_every_match():
    matches = {
        "assign": ["PASSWORD: abcdef", "passwd=1", "api_key = 'x", 'APIKEY"="y', "secret:z", 'token" : "abc'],
        "access": ["AKIA" + "A" * 16],
        "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"],
        "github": ["ghp_" + "a" * 36, "gho_" + "B" * 36],
        "slack": ["xoxb-1234567890"],
        "google": ["AIza" + "a" * 35],
        "stripe": ["sk_live_" + "a" * 16, "rk_live_" + "b" * 16],
        "jwt": ["eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10],
    }
    rules = secret_scan.BASE_RULES | secret_scan.MORE_RULES
    assert secret_scan.trigram_query(rules["hex"][0]) is None
    for kind, examples in matches.items():
        query = secret_scan.trigram_query(rules[kind][0])
        for text in examples:
            assert re.search(rules[kind][0], text) and holds(query, text.lower())
        assert not holds(query, "nothing of the kind")
    assert secret_scan.trigram_query("a|b") is None
    assert secret_scan.trigram_query("abcd?e+f") == ("or", [], [("and", ["abc", "bcd", "cde"], []), ("and", ["abc", "bce"], [])])


# --- pages


def length_of_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("bits", [200_000_000, 20])
def test_common_lines_are_longest(monkeypatch, bits):
    monkeypatch.setattr(html_extract, "TABLE_BITS", bits)
    rnd = random.Random(5)
    for _ in range(500):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(14))] for _ in range(2))
        places = html_extract.common_lines(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in places))
        assert len(set(places)) == len(places) == length_of_lcs(a, b)


def test_page_lines_and_zones():
    lines = html_extract.page_lines
    page = (
        '<html><head><title>T</title><script>var a="</p><nav>";</script></head><body class="has-sidebar"><header>H</header>'
        '<div id="cookie-notice">C</div><article><h1>A &amp; B</h1><p>x<br>y <b>z</b>w<p>q 4 < 5&nbsp; 6'
        '<div class=comments>no</div><!-- <p>gone</p> --></article><footer>f</footer></body>'
    )
    assert [t for z, t in lines(page) if z == html_extract.ARTICLE] == ["A & B", "x y zw", "q 4 < 5 6"]
    own = "<header>site</header><article><header><h1>T</h1></header><p>x</p></article>"
    assert [t for z, t in lines(own) if z == html_extract.ARTICLE] == ["T", "x"]
    assert lines("<nav>open <p>text</p>") == [(html_extract.BODY, "open"), (html_extract.BODY, "text")]
    assert lines(None) == lines("") == [] and lines("plain &lt;t") == [(html_extract.BODY, "plain <t")]


def test_furniture_never_holds_the_article():
    text = lambda page: html_extract.main_text(html_extract.page_lines(page), set())
    own = "<article><h1>T</h1><p>words</p></article>"
    for around in (
        '<div class="content has-sidebar">%s</div>', '<div class="sidebar">%s</div>', "<form>%s</form>",
        "<div hidden>%s</div>", '<section class="widget"><div class="modal">%s</div></section>',
    ):
        for inner in (own, own.replace("article", "main"), own.replace("article", "div")):
            assert text(around % inner) == "T\n\nwords", (around, inner)
    for attribute in (
        'style="overflow:hidden"', 'title="the hidden valley"', 'class="entry-header"', "id=related-work", 'class="market-share x"',
        "data-class=\"a class='ad'\"", 'aria-hidden="false"', 'style="background-color:none"',
    ):
        assert text(f"<h1>T</h1><div {attribute}><p>words</p></div>") == "T\n\nwords", attribute
    for attribute in (
        "hidden", 'style="color:red; display: none"', 'aria-hidden="true"', 'class="x site-footer"', "id='shareButtons'",
        'class="related-posts"', "role=navigation",
    ):
        assert text(f"<h1>T</h1><p>words</p><div {attribute}><p>more</p></div>") == "T\n\nwords", attribute
    noise = '<div class="comments"><article class="comment"><p>much longer than the article itself</p></article></div>'
    assert text(own + noise) == "T\n\nwords"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(4)


def test_shared_lines_of_near_pages_go(spark):
    make = lambda menu, body: f"<body><div>Site name</div><div>{menu}</div><p>{body}</p><div>Terms of use</div></body>"
    rows = [(i, f"http://h.example/news/{i:03}", make("Menu", f"Story number {i}")) for i in range(40)]
    rows += [(100, "http://other.example/x", make("Menu", "Alone")), (101, "http://h.example/news/000", rows[0][2])]
    got = {r.page_id: r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i].text == f"Story number {i}" for i in range(1, 40))
    assert got[100].text == "Site name\n\nMenu\n\nAlone\n\nTerms of use"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 42


def test_copies_meet_the_nearest_page_with_other_lines(spark):
    make = lambda body: f"<body><div>Site name</div><p>{body}</p><div>Terms of use</div></body>"
    stories = [0, 0, 1, 2, 2, 2, 2, 3, 4, 4, 4]  # copies first, in the middle and last
    rows = [(i, f"http://h.example/news/{i:03}", make(f"Story number {s}")) for i, s in enumerate(stories)]
    rows += [(100, rows[0][1], rows[0][2]), (200, "http://g.example/a", make("Twice")), (201, "http://g.example/b", make("Twice"))]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(11)] == [f"Story number {s}" for s in stories] and got[100] == got[0]
    assert got[200] == got[201] == "Site name\n\nTwice\n\nTerms of use"  # no other page on that host
    menu = [(i, f"http://h.example/news/{i:03}", make(f"Story number {i}")) for i in range(40)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, [*menu, (101, menu[0][1], menu[0][2])])).collect()}
    assert got[0] == got[101] == "Story number 0"


def test_copied_articles_stay(spark):
    page = "<nav>menu</nav><article><p>same words</p></article><footer>f</footer>"
    rows = [(1, "http://h.example/a", page), (2, "http://h.example/b", page + "<p>x</p>"), (2, "http://h.example/b", page + "<p>x</p>")]
    rows += [(3, None, None), (None, "::bad[", ""), (4, "http://h.example/c", "<p>" + "long " * 60_000)]
    got = html_extract.extract(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.text[:10]) for r in got) == [
        ("1", "same words"), ("2", "same words"), ("2", "same words"), ("3", ""), ("4", "long long "), ("None", ""),
    ]
    assert html_extract.extract(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_repeated_lines_of_an_article_go(spark, tag):
    make = lambda i: f"<{tag}><h1>Title {i}</h1><p>Send this on to a friend</p><p>{f'Words of story {i}. ' * 9}</p><p>All rights reserved</p></{tag}>"
    rows = [(i, f"http://h.example/news/{i:03}", make(i)) for i in range(6)]
    for r in html_extract.extract(pages(spark, rows)).collect():
        assert r.text == f"Title {r.page_id}\n\n" + (f"Words of story {r.page_id}. " * 9).strip()
    two = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows[:2])).collect()}
    assert all("Send this on" in text for text in two.values())  # a passage of two pages is no site line yet


def test_given_pages_give_their_articles(spark):
    import html

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", page, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks]
        return "\n\n".join(b for b in blocks if b)

    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in html_extract.op8_html_extract(spark, SMALL).collect()} == want
