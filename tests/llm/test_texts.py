"""Extraction, personal data, quality, language."""

import hashlib
import random
import re
import time

import pytest
from helpers import SCHEMA, documents, prose, table

from tidewatch.llm import html, language, privacy, quality

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x = "</p><p>no</p>";</script></head><body>
<header class=top>Site</header><nav><ul><li><a href="/">Home</a><li><a href='/b'>B</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site, all of them.</p></div>
%s<aside><p>Elsewhere on this site today.</p></aside><div id="comments"><h2>Comments</h2><p>First! I like this very much indeed, thank you.</p></div>
<form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>One <b>bold</b>\n word&nbsp;here, and some more of it.</p><div class='ad'>Buy</div><p>Two &lt;tags&gt; &#233;<br>x y z, and so on and so on.<ul><li>item</li></ul>"
WANT = "Head & line\n\nOne bold word here, and some more of it.\n\nTwo <tags> é x y z, and so on and so on.\n\nitem"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<article><section>%s</section><!-- end --></article>"])
def test_article(wrap):
    assert html.extract(PAGE % (wrap % BODY)) == WANT


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<article><p>x</article", "x"), ("<nav>only</nav>", ""), ("a < b & c", "a < b & c"),
                                       ("<script>never closed", ""), ("<p title='a>b'>q</p>", "q"), ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip())])
def test_odd_pages(page, want):
    assert html.extract(page) == want


def test_pages_table(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "clash"), (2, None, None, "clash"), (2, None, None, "clash"), (3, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.digest(df).collect()), key=str)
    assert got == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0), (3, "v", "", 0)]
    assert html.digest(df.limit(0)).count() == 0


def base(text):
    """The contract's rules written out plainly."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x.lstrip("0")[:9] or 0) < 256 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


def private():
    odd = ["\U0001f600 x@y.zz and +1 (555) 010-9999", "1.2.3.4.5.6.7.8 0001.2.3.4 300.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112 4111111111111111", "+12 3 no +1-800-555-0100 end", "0" * 5000 + ".1.1.1"]
    many = [f"write to user{i}@host{i}.example.com or call +49 30 {1000000 + i} from 10.1.{i}.7 with 4111 1111 1111 1111; ref {i * 7919:012d} v{i}.{i}.1" for i in range(60)]
    return documents() + [(100 + i, t, "en", "a") for i, t in enumerate(odd + many)]


def test_base_spans(spark):
    rows = private()
    got = privacy.detect(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {i: t for i, t, *_ in rows}
    for r in got:
        want = base(by[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r["spans"].split(","))| {""}
    assert privacy.redact("call +1 555 0100 99 now", "phone:5:19") == "call [phone] now"


def test_base_patterns_are_linear():
    """A megabyte of digits, letters or dots takes no time to speak of, and random texts have the spans of the plain patterns."""
    for long in ("7" * 1_000_000, "x" * 1_000_000 + " a@b.cc", "a@" * 300_000, "1." * 500_000, "+1" + "(" * 1_000_000, "x." * 400_000 + "@"):
        began = time.time()
        privacy.base_spans(long)
        assert time.time() - began < 2
    r = random.Random(2)
    for _ in range(4_000):
        t = "".join(r.choice(["1", "25", "0", ".", "@", "a", "-", "+", " ", "(", "b.c", "1.2.3", "4111111111111111", "é", "٣"]) for _ in range(r.randrange(24)))
        assert [f"{k}:{a}:{b}" for k, x in privacy.base_spans(t).items() for a, b in x] == base(t)


def test_loose_forms_are_added(spark):
    """Planted loose forms are caught with their exact spans, look-alikes and clean texts are left alone."""
    loose = [("email", "mail to ", f"anna{i}(at)host{i}(dot)org") for i in range(20)] + [("email", "please write to ", f"anna{i} [at] host{i} [dot] org") for i in range(20)]
    loose += [("card", "my card is ", s.join(("4111", "1111", "1111", "1111"))) for s in "./_"] + [("phone", "call me at ", f"({200 + i}) 555-{1000 + i}") for i in range(20)]
    clean = ["look at the dot on the map", "meet @ noon . then go", "order 4111.1111.1111.1112 shipped", "on 2024-01-31 and 2023/12/01 it was 12.5 or 7", "version 10.2.3 of 2021, page 1234 5678",
             "section 1 . 2 . 3 . 4 says so", "the sum 123 456 789 was paid"]
    card = lambda i: next(f"4{i % 10}11 11{i % 100:02d} 3{i % 7}11 111{c}" for c in range(10) if privacy.luhn(f"4{i % 10}1111{i % 100:02d}3{i % 7}11111{c}"))
    known = [(i, f"{prose(i, 6)} write to user{i}@host{i}.example.com or call +49 30 {1000000 + i} from 10.1.{i % 250}.7 with {card(i)}; ref {i * 7919:012d} v{i}.{i}.1", "en", "a") for i in range(400)]
    rows = known + [(5_000 + i, f"{i} {prose(i, 5)} {lead}{form} {prose(i, 4)}", "en", "a") for i, (_, lead, form) in enumerate(loose)]
    rows += [(7_000 + i, t, "en", "a") for i, t in enumerate(clean)]
    by = {i: t for i, t, *_ in rows}
    got = {r["doc_id"]: r["spans"] for r in privacy.detect(table(spark, rows)).collect()}
    want = {5_000 + i: f"{kind}:{by[5_000 + i].index(form)}:{by[5_000 + i].index(form) + len(form)}" for i, (kind, _, form) in enumerate(loose)}
    lost = {by[i]: got[i] for i in want if got[i] != want[i]}
    assert len(lost) <= 0.05 * len(want), lost
    assert [got[7_000 + i] for i in range(len(clean))] == [""] * len(clean)
    assert all(len(got[i].split(",")) == 4 for i in range(400))


def test_private_without_candidates(spark):
    assert [r["spans"] for r in privacy.detect(spark.createDataFrame([(1, "none", "en", "a"), (2, None, "en", "a")], SCHEMA)).collect()] == ["", ""]
    assert privacy.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_held_out(spark):
    rows = [(i, prose(i, 60) if i % 3 else ("BUY NOW!! " * 20 + f"OFFER{i}!! ").upper(), "en", "a") for i in range(300)] + [(900, None, "en", "a"), (901, "", "en", "a"), (902, prose(1, 9000), "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.digest(table(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(300) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    none = quality.digest(table(spark, rows), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.digest(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_language_held_out(spark):
    other = lambda i: " ".join(w[::-1] + "ß" for w in prose(i, 50).split())
    rows = [(i, prose(i, 50) if i % 2 else other(i), "en" if i % 2 else "xx", "a") for i in range(300)]
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 !?", "en", "a"), (903, prose(5, 5000), None, "a"), (904, "ДА НЕТ", None, "a"), (903, prose(5, 5000), None, "a")]
    got = [(r["doc_id"], r) for r in language.digest(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] == "en"
    held = [i for i in range(300) if by[i]["held_out"]]
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "xx") for i in held)
    kept = {r["doc_id"] for r in language.kept_languages(table(spark, rows)).collect()}
    assert kept >= set(range(300)) | {903} and not kept & {900, 901, 902}
    assert {r["lang_pred"] for r in language.digest(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()} == {"und"}
    assert language.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unlearned_scripts_and_noise_go(spark):
    r = random.Random(8)
    noise = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 80)))
    other = lambda i: " ".join(w[::-1] + "ß" for w in prose(i, 50).split())
    rows = [(i, prose(i, 50) if i % 2 else other(i), "en" if i % 2 else "xx", "a") for i in range(300)] + [(i, prose(i, 2), "en", "a") for i in range(300, 340)]
    scripts = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщы", "".join(chr(0x4E00 + i) for i in range(200)), "cfghjqwxyz"]
    rows += [(1_000 + i, noise(scripts[i % 4]), None, "a") for i in range(400)] + [(1_400, "ДА НЕТ", None, "a")]
    assert {x["doc_id"] for x in language.kept_languages(table(spark, rows)).collect()} == set(range(340))


LONG = "This sentence belongs to the article and is long enough to count as its text."


@pytest.mark.parametrize("page, want", [
    (f"<div class='content-sidebar-wrap'><main><p>{LONG}</p></main></div><p>{LONG[::-1]}</p>", LONG),
    (f"<div class='has-sidebar'><div id='no-comments'><p>{LONG}</p></div></div>", LONG),
    (f"<form action=x><article><p>{LONG}</p></article></form>", LONG),
    (f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG[::-1]}</p></article></div>", LONG),
    (f"<p>{LONG}</p><div class=comments><p>{LONG[::-1]} {LONG}</p></div>", LONG),
    (f"<article><h2><a href=/x>Linked heading</a></h2><p>{LONG}</p><ul><li><a href=/y>Linked item</a></li></ul></article>", f"Linked heading\n\n{LONG}\n\nLinked item"),
    (f"<div><a name='top'/><p>{LONG}</p></div>", LONG),
    (f"<div><a name=top><p>{LONG}</p></div>", LONG),
    (f"<div><a href='#x'/><p>{LONG}</p></div>", LONG),
    (f"<div><p><a href='#x'>Up</p><p>{LONG}</p><p>{LONG} <a href=/z/>more</a></p></div>", f"{LONG}\n\n{LONG} more"),
    (f"<div><a href=/x>Up<p>{LONG}</p></div>", LONG),
])
def test_wrappers_links_and_anchors(page, want):
    assert html.extract(page) == want


def test_private_data_is_fitted_on_all_candidates(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    seen, whole = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: seen.append(df.count()) or whole(self, df))
    monkeypatch.setattr(privacy, "TREES", 2)
    one = "struct(int(id % 4) AS kind, id AS start, id + 5 AS end, 0 AS use, id % 3 = 0 AS label, array(double(id % 3), double(id % 7)) AS features)"
    model, limits = privacy.fit(spark.range(30_000).selectExpr("id AS row", f"array({one}) AS maybe"))
    assert seen[0] > 14_000 and all(0.5 <= limits[k] <= 1 for k in range(4))
