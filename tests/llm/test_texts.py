"""Archives, pages, tokens, licenses and toxicity against brute force and edge cases."""

import hashlib
import io
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from estima.llm import bpe, html_text, licenses, toxicity, warc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


# --- WARC ---------------------------------------------------------------------------------------------------------------


def test_round_trip(spark):
    big = "<p>" + "ä" * 300 + "</p>"
    rows = [(5, "http://a/ b", big), (2, "u", big), (9, None, big), (1, "x", "short"), (3, "y", "short"), (4, "n", None), (6, "e", ""), (None, "null id", big), (7, "crlf\r\nX: y", "a\r\n\r\nb" * 40), (2, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("length", F.lit(1))
    out = warc.round_trip(df, keep_payload=True).collect()
    assert len(out) == len(rows)
    first = {}
    for key, _, html in rows:
        b = (html or "").encode()
        if key is not None and len(b) >= 100:
            first[b] = min(first.get(b, key), key)
    want = sorted(((k, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), first.get((h or "").encode()) if k is not None and first.get((h or "").encode(), k) < k else None) for k, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in out), key=str) == want
    for r in out:
        assert (r["record_type"] == "revisit") == (r["refers_to"] is not None)
        assert bytes(r["payload"]) == b"" if r["refers_to"] is not None else hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    assert warc.round_trip(df.limit(0)).count() == 0


def records(data: bytes, size: int = 7):
    stream = io.BytesIO(data)
    return [warc.read_record(p) for p in warc.members(lambda _: stream.read(size))]


def member(payload: bytes, **changed) -> bytes:
    return warc.record_bytes(1, "u", payload, changed.get("digest", hashlib.sha256(payload).hexdigest()), len(payload), None, "0")


def test_reader_checks():
    data = member(b"x" * 5000) + member(b"") + member(b"\r\n\r\n")
    assert [len(r[2]) for r in records(data)] == [5000, 0, 4]
    with pytest.raises(warc.WarcError, match="ends within"):
        records(data[:-5])
    with pytest.raises(warc.WarcError, match="not a gzip"):
        records(data + b"junk")
    raw = zlib.decompress(member(b"abc"), 31)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for wrong, message in ((raw.replace(b"abc", b"abd"), "digest"), (raw[:-1], "shorter"), (raw + b"more bytes", "longer"), (raw.replace(b"Content-Length: ", b"Content-Size: ", 1), "no content length"), (b"HTTP" + raw, "version")):
        with pytest.raises(warc.WarcError, match=message):
            records(pack(wrong))


def test_hot_payload_is_split(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", 5)
    html = [f"{i % 4}" * 200 if i % 3 else f"page {i}" * 40 for i in range(300)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    out = {r["page_id"]: r["refers_to"] for r in warc.round_trip(df).collect()}
    assert out == {i: (html.index(h) if html.index(h) < i else None) for i, h in enumerate(html)}


# --- pages --------------------------------------------------------------------------------------------------------------

PAGES = {
    "<html><body><nav>Menu</nav><article><h1>T &amp; U</h1><p>One  two\n three.<p>As.<div class='share'>Share</div></article><footer>F</footer>": "T & U\nOne two three.\nAs.",
    "<body><div id=menu><a href=#>Home</a></div><main><p>Text<br>line</p><form><p>Name</p></form><aside>Side</aside></main></body>": "Text line",
    "<article><p>Kept.</p><section class='comments'><p>I agree!</p></section><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --></article>": "Kept.",
    "<article><header class='entry-header'><h1>Title</h1></header><p>Body &lt;b&gt; &#233; &eacute;.</p></article>": "Title\nBody <b> é é.",
    "<header><p>Site</p></header><article><p>x</p></article>": "x",
    "": "",
    "<p>": "",
}


@pytest.mark.parametrize("page, text", PAGES.items())
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "A sentence that is long enough to raise the distribution of the lines, as prose does."

CASES = {
    "comments in articles": (f"<body><article class='comment'><p>{LONG * 3}</p></article><article><p>Body. {LONG}</p></article>", f"Body. {LONG}"),
    "names of a layout": (f"<body><div class='no-sidebar has-cookie-notice layout-sidebar-right related-to-life'><h1>T</h1><p>{LONG}</p><p>x</p><p>{LONG}</p></div>", f"T\n{LONG}\nx\n{LONG}"),
    "names of parts": (f"<body><div class='site-footer'>{LONG}</div><div id=comment-list>{LONG}</div><div class='cookieBanner'>{LONG}</div><p>{LONG}</p>", LONG),
    "a quote that never closes": ('<article><p>One <a title="foo>two</a> three.</p></article>', "One two three."),
    "an apostrophe in a value": ("<article><p title=O'Brien>One it's two.</p><p>It's three.</p></article>", "One it's two.\nIt's three."),
    "> in a value": ("<article><p title='a > b' data-x=\"<p>no</p>\">Yes.</p></article>", "Yes."),
    "main and a teaser": (f"<main><p>{LONG * 2}</p><article><a href=x>Teaser</a></article></main>", LONG * 2),
    "links at the ends": (f"<article><h1><a href=x>Linked title</a></h1><p>{LONG}</p><ul><li><a href=a>Ref one</a><li><a href=b>Ref two</a></ul></article>", f"Linked title\n{LONG}\nRef one\nRef two"),
    "a list of links amid": (f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul>" + "<li><a href=x>link</a></li>" * 12 + f"</ul><p>{LONG}</p><p>{LONG}</p></div>", "\n".join([LONG] * 3 + ["link"] * 12 + [LONG] * 2)),
    "closing items": (f"<body><h1>Cake</h1><p>{LONG}</p><p>{LONG}</p><ul><li>flour</li><li>eggs</li></ul><div>© 2020</div>", f"Cake\n{LONG}\n{LONG}\nflour\neggs"),
    "a form around the page": (f"<body><form id=f><div class='content'><main><p>{LONG}</p></main></div></form>", LONG),
    "short comments": ("<article><!--><p>a</p><!-- x --!><p>b</p></article>", "a\nb"),
    "an end tag in a cell": ("<article><table><tr><td>a</div></b></td><td>b</table><p>c</article>", "a\nb\nc"),
    "text in a main element before its article": (f"<nav><p>{LONG}</p></nav><main><h1>T</h1><article><p>{LONG * 2}</p></article></main>", f"T\n{LONG * 2}"),
}


@pytest.mark.parametrize("name", CASES)
def test_articles(name):
    page, text = CASES[name]
    assert html_text.main_text(page) == text


def test_every_article_of_the_pages():
    """All lines of each page's article, by a plain search for its element and block tags."""
    import html

    import pyarrow.parquet as pq

    block = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|div|blockquote|table|tr|td|pre|section|figure|figcaption)\b[^>]*>")
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in block.split(re.search(r"<article>(.*?)</article>", page, re.S)[1])]
        assert html_text.main_text(page) == "\n".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in parts) if x)


@pytest.mark.parametrize("page", ["<p><b>", "<div>", "<b>", "<li><a>", "<table><tr><td>", "</div>", '<a title="', "<!--"])
def test_linear_time(page):
    import time

    seconds = []
    for n in (2000, 16000):
        began = time.perf_counter()
        html_text.main_text("<article>x" + (page + "x") * n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * seconds[0] + 0.5


def test_surges_like_all_windows():
    r = np.random.RandomState(4)
    for _ in range(300):
        lengths, width, least = r.choice([0, 0, 5, 30, 80], r.randint(1, 25)), r.randint(1, 5), r.choice([1, 30, 60])
        enough = {(i, j) for i in range(len(lengths)) for j in range(i + 1, min(i + width, len(lengths)) + 1) if lengths[i:j].sum() >= least}
        rising = {k for i, j in enough if not enough & {(i + 1, j), (i, j - 1)} for k in range(i, j)}
        want, run = [], []
        for j in range(len(lengths) + 1):
            if j in rising:
                run.append(j)
            elif run:
                want.append((run[0], run[-1] + 1))
                run = []
        assert html_text.surges(lengths, width, least) == want


def test_distribution_without_marks():
    long = LONG + " "
    page = f"<html><head><title>t</title></head><body><div><a>Home</a> <a>News</a></div><div><a>x</a></div><h1>Title</h1><p>{long}</p><p>Short one.</p><p>{long * 3}</p><div>© 2020 Somebody</div><div><a>Terms</a></div></body></html>"
    text = html_text.main_text(page).split("\n")
    assert text[0] == "Title" and "Short one." in text and text[-1].startswith("A sentence") and len(text) == 4


def test_line_blocks():
    lengths = np.array([0, 0, 10, 20, 0, 0, 0, 0, 5])
    assert html_text.line_blocks(lengths, 3).tolist() == [10, 30, 30, 20, 0, 0, 5, 5, 5]
    assert html_text.surges(lengths, 3, 30) == [(2, 4)] and html_text.surges(lengths, 3, 1) == [(2, 4), (8, 9)]


def test_extract(spark):
    rows = [(1, "u", "<article><p>é😀</p></article>"), (2, None, None), (2, None, ""), (None, "x", "<p>" + "word " * 200000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(df).collect()
    assert sorted((r["n_chars"], len(r["text"])) for r in out) == [(0, 0), (0, 0), (2, 2), (999999, 999999)]
    assert html_text.extract(df.limit(0)).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------------------

TEXTS = ["", "Hello world, don't   stop\r\n\n  x", "naïve 日本語 😀😀👨‍👩‍👧", "a" * 3000, " \t\n  \n", "12345678 9", "\x00\x01 <|endoftext|>", "اختبار हिन्दी ไทย", "İK ﬁ é", "é" * 700]


def test_bpe_like_tiktoken(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, "")], "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    for r in bpe.encode(df, RANKS, P.PATTERN).collect():
        text = TEXTS[r["doc_id"]] if r["doc_id"] < 99 else ""
        ids = enc.encode_ordinary(text)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    for r in bpe.encode(df.where("doc_id IN (1, 2)"), RANKS, P.PATTERN, keep_decoded=False, keep_offsets=True).collect():
        text = TEXTS[r["doc_id"]]
        assert r["token_ids"] == enc.encode_ordinary(text) and len(r["token_starts"]) == len(r["token_ends"]) == r["n_tokens"]
        covered = {k for a, b in zip(r["token_starts"], r["token_ends"]) for k in range(a, b)}
        assert covered == set(range(len(text)))


def test_documents_like_tiktoken():
    import pyarrow.parquet as pq

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    own = bpe.codec(RANKS, P.PATTERN)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == enc.encode_ordinary(text) and own.decode(ids) == text


def test_bytes_and_offsets():
    table = bpe.byte_to_char()
    assert len(set(table)) == 256 and table[ord("A")] == "A"
    own = bpe.codec(RANKS, P.PATTERN)
    text = "x 😀é日"
    ids, spans = own.encode_with_offsets([text, ""])
    assert ids[0].tolist() == own.encode([text])[0].tolist() and spans[1].shape == (0, 2)
    for (a, b), i in zip(spans[0].tolist(), ids[0]):
        assert 0 <= a < b <= len(text)
        assert own.decode_bytes(np.array([i])) in text[a:b].encode()  # a part of a character spans all of it
    assert all(own.byte_of[ord(c)] == b for b, c in enumerate(table))
    half = own.encode(["😀"])[0]
    assert own.decode(half) == "😀" and (len(half) == 1 or "�" in own.decode(half[:1]))


# --- licenses ---------------------------------------------------------------------------------------------------------------


def brute_base(text: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    "Released under the MIT License. Again: UNDER-THE-mit license!", "Licensed under CC BY-NC 4.0.", "x Apache License, Version 2.0 y", None, "", "É under the mit\nlicense é",
    "no license here", licenses.TEMPLATES["bsd text"][1].upper(), "This work is licensed under the GNU General Public License, version 3.", "permission is hereby granted free of charge to nobody", "cc by nc cc by nc " * 20000,
    "// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-2.0-or-later", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.",
    "SPDX-License-Identifier: Apache-2.0 " + licenses.TEMPLATES["mit text"][1] + " x " + licenses.TEMPLATES["bsd text"][1], "the license identifier", "a " * 300000,
]


def test_scan(spark):
    df = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    out = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(LICENSED):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[7]["labels"] == "bsd" and out[8]["labels"] == "gpl-3" and out[6]["labels"] == out[9]["labels"] == out[15]["labels"] == "" and out[3]["score"] == 0
    assert [out[i]["labels"] for i in (11, 12, 13, 14)] == ["mit", "gpl-2", "gpl-3", "apache-2,bsd,mit"] and out[14]["score"] == 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_templates_with_edits_like_all_starts():
    random = np.random.RandomState(5)
    vocabulary = sorted({w for _, text, _ in licenses.TEMPLATES.values() for w in text.encode().split()})
    index = licenses.Index(dict(zip(vocabulary, random.uniform(1, 9, len(vocabulary)))), licenses.TEMPLATES, 12, 0.8, 2)
    for name, body in index.bodies.items():
        for edits in (1, 2, 2, 2, 3, 4, 5) * 6:
            words = list(body)
            for _ in range(edits):
                at, kind = random.randint(len(words)), random.randint(4)
                words[at : at + (kind == 3)] = [] if kind == 3 else [b"dnl"]
            words = [b"x"] * random.randint(4) + words + [b"the"] * random.randint(3)
            best = {}
            for template, other in index.bodies.items():
                for start in range(-2 - len(other), len(words) + 2):
                    share = index._share(other, words, start) / index.weight[template]
                    near = words[max(0, start - 2) : max(0, start + len(other) + 2)]
                    if share >= 0.8 and all(licenses._holds(near, p) for p in index.phrases[template]):
                        best[index.label[template]] = max(share, best.get(index.label[template], 0))
            assert index.scan(words)[4] == pytest.approx(best), (name, words)


def test_scan_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in licenses.scan(df).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text[r["doc_id"]])


# --- toxicity ------------------------------------------------------------------------------------------------------------------


def test_nnpu_learns_from_positives_and_unlabelled():
    r = np.random.RandomState(1)
    n_p, n_u = 200, 2000
    toxic = np.concatenate([np.ones(n_p, bool), r.rand(n_u) < 0.1])
    mark = np.where(toxic, r.rand(n_p + n_u) < 0.9, r.rand(n_p + n_u) < 0.02)
    noise = r.rand(n_p + n_u) < 0.3
    rows = np.concatenate([np.flatnonzero(mark), np.flatnonzero(noise)])
    columns = np.concatenate([np.zeros(mark.sum(), int), np.ones(noise.sum(), int)])
    positive = np.arange(n_p + n_u) < n_p
    w, e = toxicity.nnpu(rows, columns, np.ones(len(rows)), np.ones((n_p + n_u, 1)), positive, 2, 0.1)
    assert w[0] > 3 and abs(w[1]) < w[0] / 3 and e[0] < -1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    r = out.agg(F.count_if((F.col("toxic") == 1) & (F.col("__predicted") == 1)), F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 0) & (F.col("__predicted") == 1)), F.count_if(F.col("toxic") == 0)).first()
    assert r[0] >= 0.9 * r[1] and r[2] <= 0.03 * r[3]


def test_clashing_names_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"idiot scum {i}", 5, 6) for i in range(50)] + [(i, f"fine words {i}", 5, 6) for i in range(100, 200)], "doc_id long, text string, __score int, __PREDICTED int")
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 1)] + [(i, 1, 0) for i in range(100, 150)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "__score_", "__predicted_"] and out.agg(F.sum("__score"), F.count("__predicted_")).first()[:] == (750, 150)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "idiot scum idiot"), (2, None), (2, ""), (None, "x " * 300000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["__score"] <= 1 for r in out)
    by = [r["__score"] for r in out if not r["text"]]
    assert by[0] == by[1]
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels).weights == {}
