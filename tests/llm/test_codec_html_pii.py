"""Round trips and hand cases of the BPE codec, the HTML extractor and the pseudonyms."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusforge.llm import bpe_codec, html_extract, pii, queries

from cases import EDGES


@pytest.fixture(scope="module")
def codec():
    return queries.codec()


def test_encode_like_tiktoken(codec, docs_of):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(P.path(queries.VOCABULARY)), special_tokens={})
    rng = random.Random(2)
    pieces = bpe_codec.Pieces(codec.model, codec.pattern)
    for _ in range(3000):
        text = "".join(rng.choice("abctheéüñß日本Ж \n\t .,!'s01²€") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(pieces.ids(text), "<u4").tolist() == enc.encode_ordinary(text)
    out = bpe_codec.decode(bpe_codec.encode(docs_of(EDGES), codec), codec).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in out) == sorted((i or -1, (t or "").encode()) for i, t in EDGES)
    by_id = {r.doc_id: r for r in out}
    assert np.frombuffer(bytes(by_id[8].ids), "<u4").tolist() == enc.encode_ordinary(EDGES[9][1])
    assert by_id[1].n_tokens == 0 and bpe_codec.encode(docs_of([]), codec).count() == 0


def test_offsets_and_split_characters(codec, docs_of):
    text = "naïve 日本 🙂 end"
    row = bpe_codec.encode(docs_of([(1, text)]), codec, offsets=True).first()
    ids = np.frombuffer(bytes(row.ids), "<u4")
    assert len(row.starts) == len(row.ends) == len(ids) and row.ends[-1] == len(text)
    for i, s, e in zip(ids.tolist(), row.starts, row.ends):
        token = codec.tokens[i]
        assert token in text[s:e].encode()  # whole, or bytes of a character that several tokens share
    for n in range(len(ids) + 1):
        part = b"".join(codec.tokens[i] for i in ids[:n].tolist())
        assert text.startswith(bpe_codec.decoded_text(part).rstrip("�"))


def test_query_digests(codec, docs_of):
    out = {r.doc_id: r for r in queries.encoded_digests(docs_of(EDGES)).collect()}
    assert out[2].n_tokens == 0 and out[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[7].decoded_sha256 == hashlib.sha256(EDGES[8][1].encode()).hexdigest()


PAGE = """<html><head><title>No</title><script>var a="<p>no</p>";</script></head><body><header><a href="/">No home</a></header>
<nav><ul><li><a href="/a">No menu</a></li></ul></nav><div class="cookie-notice">No cookies</div>
<main><div id="sidebar"><p>No side</p></div><article><h1>The  title</h1><p>First &amp; longest paragraph of the <b>article</b>,
over two lines and more.<p>Of.</p><div class="ad-box">No advert</div><ul><li>a point</li></ul><form><label>No form</label></form>
<p>Last&nbsp;one with caf&eacute;</article></main>
<section class="comments"><p>No comment that is long enough to look like an article, if one only counts its letters.</p></section>
<footer>No footer</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == ("The title\nFirst & longest paragraph of the article, over two lines and more.\nOf.\na point\nLast one with café")
    for page in ("", "   ", "<![x[ y", "a <![if IE]> b", "<a " * 20_000, "<p>", "plain text", "<div class=ad>x", "<b><i></b></i>", "</p></div>", "<!-- x", "<p>a<br>b"):
        html_extract.main_text(page)
    assert html_extract.main_text("<html><body><p>Only text here.</p></body>") == "Only text here."


@pytest.mark.parametrize("outer", ["article", "main", "div class=post"])
@pytest.mark.parametrize("inner", ["div", "section", "blockquote"])
def test_whole_article_around_its_longest_part(outer, inner):
    body = "".join(f"<p>A long paragraph number {i} of the body that holds most of the text of the page.</p>" for i in range(12))
    page = (f"<html><body><ul><li><a href=/>Menu entry</a></li></ul><{outer}><h1>Title</h1><p>Lead</p><{inner}>{body}</{inner}><p>Closing</p>"
            f"</{outer.split()[0]}></body></html>")
    lines = html_extract.main_text(page).split("\n")
    assert (lines[:2], lines[-1], len(lines)) == (["Title", "Lead"], "Closing", 15)


def test_lists_of_links_and_pages_of_link_text():
    text = "<p>A long paragraph of the article that holds some of the text of the page.</p>" * 4
    listed = html_extract.main_text(f"<body><article>{text}<ul><li><a href=/a>First source</a></li><li><a href=/b>Second source</a></li></ul></article></body>")
    assert listed.endswith("First source\nSecond source")
    unclosed = html_extract.main_text(f"<body><div><a name=top>{text}</div><div>{"<p>Short</p>" * 4}<p>Short end</p></div></body>")
    assert unclosed.count("A long paragraph") == 4 and unclosed.endswith("Short end")


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", PAGE, "t"), (3, "u", "<p>" + "long " * 50_000, "t")],
                                  "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert out[1].text == out[2].text == "" and out[1].n_chars == 0 and out[2].url is None
    assert out[None].text.startswith("The title") and out[3].n_chars == 249_999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pseudonyms():
    f = pii.Feistel(b"key")
    text = ("card 4111-1111-1111-1111 and 4111111111111111, not 4111111111111112; DE89 3704 0044 0532 0130 00; 123-45-6789, not 000-45-6789; "
            "(212) 555-0147; 10.0.0.255, not 256.1.1.1; 2024-02-29 is 29.02.2024 and 02/29/2024, not 2023-02-29")
    out, counts = pii.pseudonymise_text(f, text)
    assert counts == {"iban": 1, "date": 3, "address": 1, "phone": 1, "social": 1, "card": 2}
    assert re.sub(r"\w", "x", out) == re.sub(r"\w", "x", re.sub(r"10\.0\.0\.255", re.search(r"; ([\d.]+), not 256", out)[1], text))
    assert pii.pseudonymise_text(f, out, back=True)[0] == text
    cards = re.findall(r"card (\S+) and (\d+),", out)[0]
    assert cards[0].replace("-", "") == cards[1] != "4111111111111111" and pii.luhn_digit(cards[1][:-1]) == cards[1][-1]
    days = re.search(r"(\d{4})-(\d\d)-(\d\d) is (\d\d)\.(\d\d)\.(\d{4}) and (\d\d)/(\d\d)/(\d{4})", out).groups()
    assert days[:3] == (days[5], days[4], days[3]) == (days[8], days[6], days[7])
    assert all(x in out for x in ("4111111111111112", "000-45-6789", "256.1.1.1", "2023-02-29"))
    assert pii.pseudonymise_text(pii.Feistel(b"other"), text)[0] != out


@pytest.mark.parametrize("value, kind", [("1980-05-06", "date"), ("10.1.2.3", "address"), ("4111 1111 1111 1111", "card"), ("123-45-6789", "social"),
                                         ("212-555-0147", "phone"), ("DE89 3704 0044 0532 0130 00", "iban")])
def test_values_in_brackets(value, kind):
    f = pii.Feistel(b"key")
    for text in (f"born ({value}) here", f"({value}", f"((212) 555-0147 ({value}))"):
        out, counts = pii.pseudonymise_text(f, text)
        assert value not in out and counts[kind] >= 1 and sum(counts.values()) == 1 + text.startswith("((")
        assert pii.pseudonymise_text(f, out, back=True) == (text, counts)


@pytest.mark.parametrize("behind", [" AND", " 2024", " ANDERS", " GB82 WEST 1234 5698 7654 32", " 10.1.2.3", " 2024-02-29", " 4111 1111 1111 1111"])
def test_what_follows_an_iban(behind):
    f = pii.Feistel(b"key")
    alone = pii.pseudonymise_text(f, "BE68 5390 0754 7034")[0]
    out, counts = pii.pseudonymise_text(f, "BE68 5390 0754 7034" + behind)
    n = 1 if behind in (" AND", " 2024", " ANDERS") else 2
    assert out.startswith(alone) and "7034" not in out and (sum(counts.values()), out.endswith(behind)) == (n, n == 1)
    assert pii.pseudonymise_text(f, out, back=True)[0] == "BE68 5390 0754 7034" + behind
    text = "BE685390075470341234, BE68 5390 0754 7035 AND"
    assert pii.pseudonymise_text(f, text) == (text, dict.fromkeys(pii.KINDS, 0))


def test_permutation_is_one_to_one():
    f = pii.Feistel(b"k")
    for size in (1, 2, 10, 97, 1000):
        image = [f.permute("t", x, size) for x in range(size)]
        assert sorted(image) == list(range(size))
        assert [f.permute("t", y, size, back=True) for y in image] == list(range(size))


def test_pseudonymise_edges(docs_of):
    rows = [*EDGES, (50, "ip 10.1.2.3"), (51, "ip 10.1.2.3"), (52, "x" * 100_000 + " 10.1.2.3")]
    out = {r.doc_id: r for r in pii.pseudonymise(docs_of(rows), b"k").collect()}
    assert out[1].text is None and out[2].text == "" and out[7].text == EDGES[8][1]
    assert out[50].text == out[51].text != "ip 10.1.2.3" and out[52].text.endswith(out[50].text[2:]) and out[52].n_address == 1
    assert pii.pseudonymise(docs_of([]), b"k").count() == 0


@pytest.mark.parametrize("text, kind, left", [
    ("4111 1111 1111 1111 123", "card", " 123"), ("378282246310005 1234", "card", " 1234"), ("card 4111-1111-1111-1111 99 98", "card", " 99 98"),
    ("1980-05-06T10:00", "date", "T10:00"), ("born 31/12/2020", "date", ""), ("+12125550147", "phone", ""), ("be68 5390 0754 7034", "iban", ""), ("be68539007547034 und", "iban", " und")])
def test_values_that_were_left_in_clear(text, kind, left):
    for key in (b"key", b"other", b"third"):
        f = pii.Feistel(key)
        out, counts = pii.pseudonymise_text(f, text)
        assert counts[kind] == 1 and out != text and len(out) == len(text) and out.endswith(left)
        assert pii.pseudonymise_text(f, out, back=True) == (text, counts)


def test_a_number_behind_another():
    out, counts = pii.pseudonymise_text(pii.Feistel(b"key"), "no 1234 4111 1111 1111 1111")
    assert counts["card"] == 1 and out.startswith("no 1234 ") and "4111 1111 1111 1111" not in out


def brute_values(text):
    """Cards, found by trying every run of digit groups; the values that must not stay in the text."""
    import itertools
    import re
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text)]
    found = []
    for i, j in itertools.combinations_with_replacement(range(len(groups)), 2):
        span = text[groups[i][0]:groups[j][1]]
        d = re.sub(r"\D", "", span)
        if 13 <= len(d) <= 19 and re.fullmatch(r"\d+(?:[ -]\d+)*", span) and len(set(d)) > 1 and sum(
                sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            found.append(span)
    return found


def test_no_card_of_random_rows_of_numbers_stays():
    import random
    rng = random.Random(3)
    f = pii.Feistel(b"key")
    for _ in range(300):
        payload = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 14, 15, 18])))
        number = payload + pii.luhn_digit(payload)
        shown = " ".join(number[i:i + 4] for i in range(0, len(number), 4)) if rng.random() < 0.5 else number
        text = f"pay {shown} {rng.choice(['', '12', 'now', '4 of 5', '123'])}".strip()
        out, counts = pii.pseudonymise_text(f, text)
        assert counts["card"] >= 1 and shown in brute_values(text) and shown not in out
        assert pii.pseudonymise_text(f, out, back=True)[0] == text


@pytest.mark.parametrize("name", ["layout no-sidebar", "content has-header", "post comments-open", "entry-related-work", "article-share", "legal-article", "main header-fixed",
                                  "page skip-link-target", "main-content-with-footer"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "{}"])
def test_wrappers_with_names_like_furniture(name, inner):
    body = "<h1>The title</h1><p>First paragraph of the text with words.</p><p>More of the text, and its end.</p>"
    for attr in ("class", "id"):
        page = f"<nav><a href=x>Home</a></nav><div {attr}='{name}'>{inner.format(body)}</div><div class='sidebar'><p>Other</p></div>"
        assert html_extract.main_text(page) == "The title\nFirst paragraph of the text with words.\nMore of the text, and its end."


def test_furniture_inside_a_line_and_formulas():
    page = "<article><p>After <button>b</button> more text here</p><p>Let <math><mi>x</mi></math> be <span class='share'>Share</span> a number.</p></article>"
    assert html_extract.main_text(page) == "After more text here\nLet x be a number."


def test_end_tags_out_of_order_cost_linear_time():
    import time
    took = []
    for n in (4000, 16000):
        begin = time.process_time()
        html_extract.main_text("<b>" * n + "<i>" * n + "<div>text</div>" + "</b>" * n)
        took.append(time.process_time() - begin)
    assert took[1] < 12 * took[0] + 1


def test_pages_against_their_article_elements(spark):
    """The text of every page of the small tables is that of its article element, read by plain string work."""
    import re
    from html import unescape
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        found = re.findall(r"<article[^>]*>(.*?)</article>", r.html or "", flags=re.S)
        if len(found) != 1 or re.search(r"<(?:aside|nav|form|script|style|table|pre|header|footer|figure|button|ul|ol|!--)|class=|hidden|<!\[", found[0]):
            continue
        blocks = re.split(r"</?(?:p|h\d|div|section|blockquote|li|br ?/?)[^>]*>", found[0])
        want = [x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x]
        assert html_extract.main_text(r.html).split("\n") == want


def test_ids_are_written_before_they_are_decoded(docs_of):
    """One Python step in the stage, so a task holds one worker; rows and digests are those of the two steps."""
    docs = docs_of([(1, "some words"), (2, None), (None, "\u00e9\u4e2d"), (1, "some words"), (4, "")])
    got = queries.encoded_digests(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    c = queries.codec()
    plain = bpe_codec.decode(bpe_codec.encode(docs, c), c).collect()
    want = [(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in plain]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
