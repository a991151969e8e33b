"""HTML, URLs, archives, quality and the pipeline."""

import hashlib

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F
from terraprofile.llm import html_extract, quality, url_filter, warc
from terraprofile.llm.queries import URL_RULES
from terraprofile.session import scratch_path


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it(spark):
    article = "<article><h1>Head &amp; line</h1><p><b>one<br>two<p>three\n  four &eacute;</p><form><p>mail</p></form><div class='comments'><p>nice</p></div><aside>x</aside></article>"
    pages = [(1, "http://a.org/1", page(f"<nav><ul><li><a href='/'>Menu</a></ul></nav><div class='ad'>Buy</div>{article}<footer>&copy;</footer>")), (2, None, None), (3, "x", ""), (4, "http://a.org/2", "<p>unclosed <b>text"), (4, "http://a.org/2", "<p>unclosed <b>text")]
    rows = html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = sorted((r.page_id, r.text) for r in rows)
    assert got == [(1, "Head & line\none two\nthree four é"), (2, ""), (3, ""), (4, "unclosed text"), (4, "unclosed text")]


def test_template_of_a_host_is_induced(spark):
    rows = [(i, f"http://b.org/{i}", page(f"<div><p>Our site</p><p>Since 1999</p></div><div><p>story {i}</p><p>more {i * i}</p></div><div><p>Call us</p></div>")) for i in range(6)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"story {i}\nmore {i * i}" for i in range(6)}
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_and_slots_decide_around_articles(spark):
    inside = [(i, f"http://c.org/{i}", page(f"<article><div class='x'>You are reading C</div><p>story {i}</p><p>more {i * i}</p><p>Write to us</p></article>")) for i in range(5)]
    story = lambda i: f"long story {i} " * 20 + "end"
    teasers = lambda i: "".join(f"<article><h2>see {i}-{k}</h2></article>" for k in range(3))
    beside = [(i, f"http://d.org/{i}", page(f"<div class='x'><p>{story(i)}</p></div><div class='y'>{teasers(i)}</div>")) for i in range(10, 14)]
    copies = [(i, "http://e.org/x", page("<article><p>the same</p></article>")) for i in range(20, 25)]
    part = [(30, "http://f.org/1", page(f"<div><p>{story(1)}</p></div><article><p>one note</p></article>"))]
    rows = spark.createDataFrame(inside + beside + copies + part, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.main_text(rows).collect()}
    assert {i: found[i] for i in range(5)} == {i: f"story {i}\nmore {i * i}" for i in range(5)}
    assert {i: found[i] for i in range(10, 14)} == {i: story(i) for i in range(10, 14)}
    assert {found[i] for i in range(20, 25)} == {"the same"}
    assert found[30] == f"{story(1)}\none note"


def test_each_layout_of_a_host_has_its_reference(spark):
    rows = [(0, "http://b.org/0", None), (1, "http://b.org/1", ""), (2, "http://b.org/2", "<div> </div>")]
    rows += [(i, f"http://b.org/{i}", page(f"<div><p>Our site</p><p>Since 1999</p></div><div><p>story {i}</p><p>more {i * i}</p></div>")) for i in range(3, 9)]
    rows += [(i, f"http://b.org/{i}", page(f"<table><tr><td>Archive</td><td>entry {i}</td></tr></table><section><p>Call us</p><p>text {i}</p></section>")) for i in range(20, 24)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {0: "", 1: "", 2: ""} | {i: f"story {i}\nmore {i * i}" for i in range(3, 9)} | {i: f"entry {i}\ntext {i}" for i in range(20, 24)}


def test_tree_matching_pairs_the_most_nodes():
    leaf = lambda k: ["p.", k, []]
    size, pairs = html_extract.match(["d", 0, [leaf(1), leaf(2), leaf(3)]], ["d", 0, [leaf(9), leaf(1), leaf(2), leaf(3)]])
    assert size == 7 and [(i, j) for i, j, _ in pairs] == [(0, 1), (1, 2), (2, 3)]
    assert html_extract.match(["d", 0, []], ["e", 0, []])[0] == 0


def test_wide_nodes_pair_as_narrow_ones():
    def wide(n):
        flat = lambda salt: ["d", 0, [["p.", salt + k, []] for k in range(1, n)] + [["p.", 7, []]]]
        a, b = flat(10_000), flat(20_000)
        b[2].insert(3, ["div.ad", 5, []])
        return a, b

    for n in (20, 700):  # the kind that one page lacks doesn't stop the pairing
        a, b = wide(n)
        assert html_extract.match(a, b)[0] == 1 + n + 1
        assert [same for _, same in html_extract.votes(a, b)] == [0] * (n - 1) + [1]
    chance = np.random.default_rng(5)
    for _ in range(60):
        x, y = ([[f"k{chance.integers(3)}", 0, [["p.", int(k), []] for k in chance.integers(1, 4, 3)]] if chance.random() < 0.3 else [f"k{chance.integers(3)}", int(chance.integers(1, 5)), []] for _ in range(chance.integers(1, 30))] for _ in range(2))
        assert html_extract._align_wide(x, y) == html_extract._align(x, y)


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in map(url_filter.parse_rule, URL_RULES) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_urls_follow_the_longest_rule(spark):
    urls = [None, "", "x", "http://", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://com", "http://com/", "http://q.net/es/1", "http://q.net/fr", "http://q.net/fr/?://", "http://notexample.com/en/", "https://h.org/a://b", "a" * 5000]
    urls += [f"http://s{i}.com/p{i}" for i in range(30)] + [f"http://s{i}.net/es/{i}" for i in range(30)]
    frame = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, suffix int, rule string")
    rows = url_filter.judge_urls(frame, [url_filter.parse_rule(r) for r in URL_RULES]).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    alone = url_filter.judge_urls(frame.where("page_id < 4"), [url_filter.parse_rule(r) for r in URL_RULES])
    assert {r.verdict for r in alone.collect()} == {"allow"}


def test_archives_round_trip_and_skip(spark):
    big, odd = "b" * 1500, "\r\n\r\n" + "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2\nX: y", big), (3, None, "b"), (4, "http://a/4", "b"), (5, "u", None), (6, "u", odd), (7, "u", odd + "x"), (8, "http://long", "q" * 3_000_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    uri = scratch_path(spark, "w")
    assert warc.write_warc(warc.with_revisits(frame), uri) == len(pages)
    rows = {int(r.record_id): r for r in warc.read_warc(spark, uri).collect()}
    for i, _, html in pages:
        raw, r = (html or "").encode(), rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", "2") if i == 1 else ("response", None))
        assert bytes(r.payload) == (b"" if i == 1 else raw)
    back = warc.read_warc(spark, uri, payloads="false")
    assert back.where("record_type = 'revisit'").count() == 1 and back.where("payload is not null").count() == 0
    assert [r.target_uri for r in back.where("record_id = '4'").collect()] == ["http://a/4"]
    empty = scratch_path(spark, "w")
    assert warc.write_warc(warc.with_revisits(frame.where("false")), empty) == 0 and warc.read_warc(spark, empty).count() == 0


def test_chains_equal_enumeration():
    chance = np.random.default_rng(3)
    sizes, moves = np.array([3, 1, 4]), chance.normal(size=(2, 2))
    scores = chance.normal(size=sizes.sum())
    marginal, pairs, logs = quality._chains(scores, sizes, moves)
    at, expected = 0, np.zeros((2, 2))
    for n, log in zip(sizes, logs):
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(s * v for s, v in zip(scores[at : at + n], y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(s * v for s, v in zip(scores[at : at + n], y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            for a, b in zip(y, y[1:]):
                expected[a, b] += w / total
        assert np.allclose(marginal[at : at + n], good / total) and np.isclose(log, np.log(total))
        at += n
    assert np.allclose(pairs, expected)


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.select("doc_id", "text").limit(0).unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "Some text."), (10**9 + 2, "line\n" * 3000)], "doc_id long, text string"))
    field = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text").unionByName(odd), field).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [r for r in rows if r.held_out and r.quality is not None]
    right = sum(r.predicted == r.quality for r in judged)
    assert right >= 0.95 * len(judged)
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.score(docs.where("false"), field).count() == 0


def test_pipeline_stages_keep_columns_and_do_their_work(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts.append(docs.count())
        else:
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_deep_and_unclosed_pages_are_linear():
    import time

    start = time.process_time()
    deep = html_extract.parse("<div>" * 100_000 + "text" + "</div>" * 100_000)
    assert html_extract.own_text(deep) == html_extract.own_text(html_extract.parse("<p>text</p>"))
    html_extract.layout(html_extract.compact(deep))
    for page in ("<a " * 300_000, '<a "' * 250_000, "<a x='>'" * 100_000, "<!" * 300_000, "<span class='ad'>" * 60_000, "</b>" * 200_000, "<i>" * 100_000 + "</b>" * 100_000, "<div " * 200_000 + ">"):
        html_extract.parse(page)
    assert time.process_time() - start < 40


def test_stray_quotes_and_nested_inline_asides():
    def texts(page):
        out, todo = [], [html_extract.parse(page)]
        while todo:
            node = todo.pop()
            out += [node.text] if node.text is not None else []
            todo += reversed(node.children)
        return out

    assert texts("<p title=it's>first</p><p>second it's</p><p>third</p>") == ["first", "second it's", "third"]
    assert texts("<p><span class='ad'>x <span>y</span> z</span> tail</p>") == ["tail"]
    assert texts("<p title=\"a > b\">one</p><p data-x='<b>'>two</p>") == ["one", "two"]
    assert texts("<p>a <span class=ad>b</p><p>c</p>") == ["a b", "c"]
    assert texts('<p>open "quote <b>bold</b></p><p class="never closed>x</p><p>y</p>')[0] == 'open "quote bold'


def test_a_deep_page_goes_through_the_whole_job(spark):
    pages = [(k, f"http://h{k % 2}.example.com/{k}", "<div>" * (3000 if k == 1 else 2) + f"<p>Some words of page {k} stand here.</p>") for k in range(8)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Some words of page {k} stand here." for k in range(8))
