import html
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import SCHEMA, WORD, corpus, mixture_targets, personal, words
from pyspark.sql import functions as F

from granary.llm import decontamination, extraction, language, mixing, pii, sharding

SMALL = "/root/testdata/sf0.001"


# decontamination


def test_leaks_are_found_with_edits_and_clean_texts_are_left(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(20, 60))) for i in range(12)] + [(50, words(rng, 20)), (51, None), (None, words(rng, 30)), (52, "short"), (53, "")]
    items.append((54, items[0][1].upper()))  # alike after normalisation
    docs, want = [], set()
    for i in range(40):
        body = words(rng, rng.randint(5, 300)).split()
        if i < 24:
            item = items[i % 12]
            leak = list(item[1])
            for _ in range(i // 12 * int(0.04 * len(leak))):  # half of the leaks with edits
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            k = rng.randrange(len(body))
            text = " ".join(body[:k]) + " | " + "".join(leak).replace(" ", ",\n", 2) + ". " + " ".join(body[k:])
            want.add((i, item[0]))
            if item[0] == 0:
                want.add((i, 54))
        else:
            text = " ".join(body)
        docs.append((i, text, None, None, None, None, None, None))
    docs += [(90, None, None, None, None, None, None, None), (91, "", None, None, None, None, None, None), docs[0], (92, "y" * 50_000 + " " + items[50 - 50][1], None, None, None, None, None, None), (None, items[1][1], None, None, None, None, None, None)]
    want |= {(92, 0), (92, 54), (None, 1)}
    df, bench = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) + 2  # the repeated row's two
    for r in got:
        if r["doc_id"] == 92:
            assert (r["start"], r["distance"]) == (50_001, 0)
    kept = decontamination.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want}


def folded(t, trim=True):
    x = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t.lower())
    return x.strip() if trim else x


def best_distance(pattern, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        row = [i + 1]
        for j, d in enumerate(text):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        last = row
    return min(last)


def test_leaks_against_plain_alignment(spark):
    rng = random.Random(16)
    items = [(i, words(rng, rng.randint(10, 22))) for i in range(6)] + [(20, "Who wrote Hamlet?"), (21, "in the year 1603 or so"), (22, "yes"), (23, "a a a a a a a a a a"), (24, "a" * 60), (25, "!?")]
    docs = []
    for i in range(60):
        leak = list(items[i % 6][1])
        for _ in range(rng.randint(0, int(0.12 * len(leak)))):
            k = rng.randrange(len(leak))
            leak[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        docs.append((i, words(rng, rng.randint(0, 6)) + " " + "".join(leak) + " " + words(rng, rng.randint(0, 6))))
    docs += [(100, "So: who wrote  HAMLET, then"), (101, "whowrote hamlet"), (102, "Who wrote Hamlets"), (103, "Yes!"), (104, "yes and no"), (105, "b " + "a " * 30), (106, "a" * 3000), (107, "in the year 1603 or so"), (108, ""), (109, None), (110, "in the year 1603 or son, in the year 1603 or so")]
    want = set()
    for d, t in docs:
        x = folded(t or "")
        for k, p in items:
            p = folded(p)
            n = len(p)
            e = int(decontamination.RATE * n) if n >= decontamination.LEAST_CHARS else 0
            while e and n + 1 - decontamination.Q * (e + 1) < 1:
                e -= 1
            if n >= decontamination.LEAST_CHARS and best_distance(p, x) <= e or decontamination.Q <= n < decontamination.LEAST_CHARS and f" {p} " in f" {x} " or 0 < n < decontamination.Q and x == p:
                want.add((d, k))
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    by, texts = dict(items), dict(docs)
    for r in got:
        part, p = folded(texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode(), False), folded(by[r["item_id"]])
        assert best_distance(p, part) == r["distance"] and len(part) <= len(p) + r["distance"]


def test_one_long_row_of_one_sign(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_HITS", 5_000)
    rng = random.Random(2)
    leak = words(rng, 25)
    passages = decontamination.Passages([(1, "a" * 60), (2, leak), (3, "ab " * 30), (4, "b" * 70)], decontamination.Q, decontamination.RATE)
    texts = ["a" * 60_000 + " " + leak + " " + "c" * 500, "ab " * 20_000, "x" * 100, "a" * 59 + " " + leak[:-3]]
    got = list(decontamination.leaks(passages, pa.array(texts)))
    assert {(r, p, d) for r, p, d, *_ in got} == {(0, 1, 0), (0, 2, 0), (1, 3, 0), (3, 1, 1), (3, 2, 3)}
    r = next(x for x in got if x[:2] == (0, 2))
    assert texts[0][r[3] : r[4]] == leak


def test_passages_go_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    rng = random.Random(8)
    items = [(i, words(rng, 30)) for i in range(6)]
    docs = spark.createDataFrame([(i, "a " + t + " b") for i, t in items], "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(6)}
    assert decontamination.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_no_documents_or_no_passages(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontamination.find_leaks(docs, items).count() == 0 and decontamination.find_leaks(one, items).count() == 0
    assert decontamination.drop_leaks(one, items).count() == 1


# language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, ~language.held_out())
    got = language.predict(docs, model).withColumn("h", language.held_out()).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("h and n_chars >= 20").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def plain_language(text, model):
    """(language, score) by the definition, byte by byte."""
    raw = (text or "").encode()
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0
    x = [b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 0x80 else 0 for b in raw]
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            x[i] += 0x20
    margins, n = [0.0] * model.code.shape[1], 0
    for a, b, c in zip(x, x[1:], x[2:]):
        if b and (a or c):
            f = ((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 16
            margins = [m + float(w) for m, w in zip(margins, model.weights[f])]
            n += 1
    margins = [m / math.sqrt(max(n, 1)) for m in margins]
    loss = [sum(float(w) * math.log1p(math.exp(-m if bit else m)) for m, bit, w in zip(margins, word, model.bits)) for word in model.code]
    shares = [math.exp(min(loss) - v) for v in loss]
    return model.languages[loss.index(min(loss))], max(shares) / sum(shares)


def test_predictions_against_plain_decoding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~language.held_out())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, "12 !?"), (1003, "Ünd ÀÉ"), (1004, "a"), (1005, "ab"), (1006, "the " * 3000)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        lang, score = plain_language(t, model)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4, (i, t)


def test_codes_correct_errors():
    for n in (2, 4, 9, 40):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    assert min(int((a != b).sum()) for i, a in enumerate(language.codewords(9)) for b in language.codewords(9)[:i]) >= 7


def test_odd_texts_and_missing_labels(spark):
    rows = [(1, "the cat and the dog are here with it", "en"), (2, "der hund und die katze sind nicht da", "de"), (3, None, "en"), (4, "", None), (5, "123 !!! ...", "de"), (6, "Ωμέγα", None), (None, "the dog", "en"), (1, "the cat and the dog are here with it", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"] and got[6]["lang_pred"] in ("en", "de")
    assert language.accepted(df, model).columns == df.columns and language.accepted(df, model).where("doc_id in (3, 4, 5)").count() == 0
    assert language.train(df, F.lit(False)) is None
    assert {r["lang_pred"] for r in language.predict(df, None).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0
    one = language.train(df.where("doc_id = 1"), F.lit(True))
    assert language.predict(df.where("doc_id = 1"), one).first()["lang_pred"] == "en"


# extraction


def page(body, title="T"):
    return f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page("<nav><a>menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three</p><p>  a\n b </p></article><footer>f</footer>"), "Head\n\nOne & two three\n\na b"),
        (page("<div class='cookie-banner'>We use cookies</div><main><p>Body text one.</p><aside>side</aside><form><label>mail</label></form><p>Body two.</p></main>"), "Body text one.\n\nBody two."),
        (page("<article><p>Text <script>var a='<p>x</p>'</script>here</p><section class='comments'><p>A reader writes a lot of words here, more than the text.</p></section></article>"), "Text here"),
        (page("<header><h1>Site</h1></header><div id='content'><h2>Title</h2><p>The long main text of this page goes on and on.</p><p>Short.</p></div><div class='sidebar'><ul><li>link</li></ul></div>"), "Title\n\nThe long main text of this page goes on and on.\n\nShort."),
        (page("<article><p><b>Never closed<br><p>Second <i>one</article><footer>&copy;</footer>"), "Never closed\n\nSecond one"),
        (page("<article><header><h1>Kept</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>x  y</pre></article>"), "Kept\n\na\n\nb\n\nc\n\nd\n\nx y"),
        (page("<article><div class='ad'>Buy</div><p>Real &lt;text&gt; &#233;&nbsp;end</p><div role='complementary'>more</div></article>"), "Real <text> é end"),
        (page("<div class='layout has-sidebar'><div class='share-tools page-banner'><article class='post comments-open'><p>Kept words.</p></article></div><div class='widget sidebar'>gone</div></div>"), "Kept words."),
        (page("<article><p>The text.</p></article><article class='comment'><p>A comment that is longer than the text.</p></article>"), "The text."),
        ("plain text", "plain text"), ("", ""), (None, ""), ("<p>", ""), ("<div><!-- never closed", ""),
    ],
)
def test_main_text(spark, html, want):
    df = spark.createDataFrame([(1, "u", html, "x")], "page_id long, url string, html string, text string")
    r = extraction.extract_pages(df).first()
    assert (r["page_id"], r["url"], r["text"], r["n_chars"]) == (1, "u", want, len(want))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page("<form id='aspnetForm'><nav><a href='/'>menu</a></nav><article><h1>Head</h1><p>The text of the page.</p></article><footer>f</footer></form>"), "Head\n\nThe text of the page."),
        (page("<form><div><h1>Head</h1><p>The text of the page, without an article.</p><p>More of it.</p></div></form><footer>f</footer>"), "Head\n\nThe text of the page, without an article.\n\nMore of it."),
        (page("<aside><main><p>The main part.</p></main></aside>"), "The main part."),
        (page("<div class='page-header-fixed'><nav><a href='/'>menu</a></nav><div><h1>Head</h1><p>The text in a wrapper with a name.</p></div></div>"), "Head\n\nThe text in a wrapper with a name."),
        (page("<main><p>The main text of this page.</p></main><aside><article><p>A teaser that is much longer than the main text of this page.</p></article></aside>"), "The main text of this page."),
        (page("<div><h1>Head</h1><p>The post.</p></div><div class='comments'><p>A reader writes a lot of words here, more than the text has.</p></div>"), "Head\n\nThe post."),
        (page("<nav><a href='/'>menu</a><a href='/b'>more of the menu</a></nav>"), ""),
    ],
)
def test_boilerplate_that_wraps_the_page_is_layout(html, want):
    assert extraction.main_text(html) == want


def test_content_outside_the_largest_section_stays():
    """Without an article or main part, the region holds every content line."""
    lead, body, closing = (" ".join(["some words of the text"] * n) for n in (4, 8, 4))
    inner = f"<p>{body}</p>" * 6
    want = "\n\n".join(["Title", lead, *[body] * 6, closing])
    assert extraction.main_text(page(f"<h1>Title</h1><p>{lead}</p><div>{inner}</div><p>{closing}</p>")) == want
    assert extraction.main_text(page(f"<div><h1>Title</h1><p>{lead}</p><blockquote>{inner}</blockquote><p>{closing}</p></div><div><a href='/'>link</a></div>")) == want


def test_whole_articles_of_the_test_pages(spark):
    import html
    import re

    for r in extraction.extract_pages(spark.read.parquet(f"{SMALL}/pages.parquet")).join(spark.read.parquet(f"{SMALL}/pages.parquet"), "page_id").collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_broken_markup():
    assert extraction.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extraction.main_text("<![foo[ a ]]> b") == "b"
    assert "x" in extraction.main_text("<article><p>x</b></i></div></p>" + "</span>" * 50)


BODY = "".join(f"<p>{'sentence of the article with many words in it ' * 4}{i}.</p>" for i in range(4))
PLAIN = "\n\n".join("sentence of the article with many words in it " * 4 + f"{i}." for i in range(4))


def test_ratio_overrules_names_and_open_heads():
    text = extraction.main_text
    menu = "<nav><a href=x>a</a><a href=y>b</a></nav>"
    assert text(f"<html><head><title>t</title><body>{menu}<article>{BODY}</article>") == PLAIN
    assert text(f"<html><head><title>t</title>{menu}<article>{BODY}</article>") == PLAIN
    assert text("<head><title>t</title>Words without a body") == "Words without a body"
    assert text(f"<body>{menu}<div id='nav-content'>{BODY}</div><footer>f</footer></body>") == PLAIN
    assert text(f"<body><article><section class='social'>{BODY}</section></article></body>") == PLAIN
    assert text(f"<body><article>{BODY}<div class='social'><a href=x>Share</a></div></article></body>") == PLAIN
    assert text(f"<body><article><p>A short article that is here.</p><section class='comments'>{BODY}</section></article></body>") == "A short article that is here."
    links = "".join(f"<a href='/{i}'>page {i}</a> " for i in range(40))
    assert text(f"<body><article>{BODY}<p>{links}</p></article></body>") == PLAIN
    assert text(f"<body><article>{BODY}<ul>{''.join(f'<li><a href=/{i}>page {i}</a></li>' for i in range(9))}</ul></article></body>") == PLAIN
    assert text(f"<body><article>{BODY}<p>see <a href=x>this</a>, <a href=y>that</a></p></article></body>") == PLAIN + "\n\nsee this, that"


def test_deep_nesting_loses_no_mark():
    n = 20_000
    start = time.time()
    page = "<div class='menu'>" * n + "<a href=x>menu</a>" + "</div>" * n + "<section>" * n + BODY + "</section>" * n
    assert extraction.main_text(page) == PLAIN
    assert extraction.main_text("<nav>" * n + "m" + "</nav>" * n + "<form>" * n + BODY + "</form>" * n) == PLAIN
    assert time.time() - start < 60


class Seen(list):
    """Counts the open elements that are looked at."""

    def __init__(self):
        super().__init__()
        self.looks = 0

    def __getitem__(self, i):
        got = super().__getitem__(i)
        self.looks += len(got) if isinstance(i, slice) else 1
        return got


@pytest.mark.parametrize("start, step", [("", "<nav>"), ("", "<form>"), ("", "<table>"), ("<p><body>", "<nav>"), ("<li><ul>" + "<div>" * 1000, "<li>x</li>")])
def test_deep_nesting_looks_at_few_elements(start, step):
    page = extraction.Lines()
    page.open = Seen()
    page.feed(start + step * 1000)
    page.close()
    assert page.open.looks < 100_000


def test_end_tags_of_deep_pages_close_what_they_did():
    """The stack of open elements after each tag, against a plain scan of it from the inside."""

    class Plain(extraction.Lines):
        def end_element(self, tag, within=frozenset()):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    break
                if self.open[i][0] in within:
                    return
            else:
                return
            super().end_element(tag)

    rng = random.Random(7)
    names = ["p", "li", "ul", "b", "a", "div", "nav", "form", "td", "tr", "table", "header", "body", "section", "head", "x-y"]
    for size in (30, 300, 3000):
        got, want = extraction.Lines(), Plain()
        for _ in range(size):
            tag = ("<", "<", "</")[rng.randrange(3)] + rng.choice(names) + ">w"
            for page in (got, want):
                page.feed(tag)
            assert got.open == want.open and got.node == want.node and got.boxes == want.boxes
        for page in (got, want):
            page.close()
        assert extraction.select(got) == extraction.select(want)


def test_whole_pages_against_a_plain_extraction(spark):
    """Every page of the table; the plain version cuts the article out by patterns, which these pages allow."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extraction.extract_pages(pages).collect()}
    right, told, wanted = 0, 0, 0
    for r in pages.collect():
        inner = re.search("(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want, text = "\n\n".join(b for b in blocks if b), got[r["page_id"]]["text"]
        a, b = Counter(want.split()), Counter(text.split())
        right, told, wanted = right + sum((a & b).values()), told + sum(b.values()), wanted + sum(a.values())
        assert text == want and got[r["page_id"]]["n_chars"] == len(text)
    assert right == told == wanted > 0  # precision and recall in words


# personal data


ODD = [
    "a@b.co x.y+z@sub.example.org. bad@host @no.no a@b.c_d@e.f", "1.2.3.4 and 256.1.1.1 or 01.002.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1112; 12 34", "+1 (555) 010-9999 and +44 20 7946 0958 x +12",
    "é ü 10.0.0.1 é a@ö.de a@b.de", "+1 (843) 555-7672 4918187128635271", "9" * 40 + " 4111111111111111", "", None, "card 4111111111111111 4111111111111111", "...1.1.1.1...", "1.1.1.1.1.1.1.1", "0000000000000", "+1-2 3", "a" * 3000,
]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(12)
    parts = ["a@b.co", "10.1.2.3", "300.1.1.1", "4111 1111 1111 1111", "+1 (212) 555-0199", "x9@y-z.io", "1", "12-34", " ", "-", ".", "word", "é", "\n", "+", "@", "0.0.0.0"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)] + [(None, "n@m.de", None, None, None, None, None, None)]
    got = pii.find_personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "n@m.de" if r["doc_id"] is None else texts[r["doc_id"]]
        counts, spans = personal(t)
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base"]) == (counts, spans), t
        assert {x for x in spans.split(",") if x} <= set(r["spans"].split(","))
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contexts_discover_what_no_pattern_sees(spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, f"{words(rng, 5)} reach user{i}@mail.org now"))
    rows += [(100, "please reach user77 now"), (101, "reach user78x.99 now"), (102, "page user77 of book")]
    for i in range(40):
        rows.append((200 + i, f"see chapter12345{i} of it"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_id"] == 0 for i in range(60)) and all(got[200 + i]["n_id"] == 0 for i in range(40)) and got[102]["n_id"] == 0
    ids = [(100 + i, f"contact AB{i:06d} or AC{i:06d}", ) for i in range(3)]
    seeds = [(i, f"account 4111111111111111 and account {n}") for i, n in enumerate(["4012888888881881", "5555555555554444", "378282246310005", "6011111111111117", "30569309025904", "4222222222222222"])]
    unseen = [(50, "account 4111111111111112 closed")]
    many = seeds * 5
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(many)] + unseen[:0] + [(900, unseen[0][1])] + ids, "doc_id long, text string")).collect()}
    assert out[900]["spans"] == "id:8:24" and out[100]["n_id"] == 0


def test_keys_are_seeds_and_two_words_make_a_pattern(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'{words(rng, 6)} secret = "{k}" {words(rng, 3)}') for i, k in enumerate(keys)] + [(100, 'the secret = "AB12CD34EF56AB12CD34EF56AB12CD34EF56AB12" x'), (101, "a page of AB12CD34EF56AB12CD34EF56AB12CD34EF56AB12 x")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_key"] == 1 and got[i]["n_id"] == 0 and got[i]["base"] == "" for i in range(30))
    assert got[100]["spans"] == "id:14:54" and got[101]["spans"] == ""


def test_very_long_texts_cost_in_proportion(spark):
    text = " ".join(f"a{i} b" for i in range(70_000)) + " 10.0.0.1 u@v.org"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["base"] == f"email:{len(text) - 7}:{len(text)},ip:{len(text) - 16}:{len(text) - 8}"


# sharding


def test_bounded_loads_and_slots(spark):
    rows = corpus(5)
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    import zlib

    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    again = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_overflow_goes_clockwise_and_moves_little():
    rng = random.Random(1)
    counts = {c: rng.randint(1, 9) for c in range(4096)}
    natural = dict(sharding.virtual_nodes(24, 64, 4096))
    segments = sharding.plan(counts, 24, 64, 4096)
    load = [0] * 24
    for c, a, b, s, o in segments:
        assert o == load[s] or o <= load[s]
        load[s] += b - a
    assert max(load) - min(load) <= 1 and sum(load) == sum(counts.values())
    own = {}
    nodes = sorted(natural)
    from bisect import bisect_left

    for c in counts:
        own[c] = natural[nodes[bisect_left(nodes, c) % len(nodes)]]
    moved = sum(b - a for c, a, b, s, _ in segments if s != own[c])
    excess = sum(max(0, sum(n for c, n in counts.items() if own[c] == s) - max(load)) for s in range(24))
    assert moved <= excess + 24


def test_small_tables_shard_too(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r["size"] for r in sharding.shard_documents(df, 5).collect()) == [8, 9]
    assert sharding.shard_documents(df.limit(0)).count() == 0


# mixing


def test_targets_and_budgets(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 60)), ["a", "b", "c", "tiny", None][min(4, rng.randrange(40) // 9)] if i else "tiny") for i in range(800)]
    rows += [(9000, None, "empty"), (None, "null id here", "a"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df, rows_per_bucket=20).collect()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    want = mixture_targets(sizes)
    taken, most = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= 2 * most[s] for s in want) and len(got) == len(rows)
    for s in want:  # complete epochs precede the fraction
        copies = [r["copies"] for r in got if r["source"] == s and r["size"]]
        assert not copies or max(copies) - min(copies) <= 1
    again = mixing.mix_documents(df.repartition(7), rows_per_bucket=20).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_quality_weighs_the_draw(spark):
    rows = [(i, "w " * 10, "big") for i in range(2000)] + [(5000 + i, "w " * 10, "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = spark.range(0, 2000, 2).select(F.col("id").alias("doc_id"), F.lit(4.0).alias("quality"))
    got = [r for r in mixing.mix_documents(df, good).collect() if r["source"] == "big"]
    even = sum(r["copies"] for r in got if r["doc_id"] % 2 == 0)
    odd = sum(r["copies"] for r in got if r["doc_id"] % 2)
    assert even > 1.5 * odd and mixing.mix_documents(df.limit(0)).count() == 0


def test_labelling_a_batch_takes_little_beside_it():
    model = language.Model(["a", "b", "c", "d"], language.codewords(4), np.ones((language.DIMS + 1, 7), np.float32), np.ones(7))
    texts = pa.array(["the words of a text " * 150] * 1000)
    tracemalloc.start()
    language.label(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
