"""WARC archives, GIF columns and main text of pages."""

import base64
import functools
import hashlib
import html as H
import io
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import gif, queries, sitetree, warc
from tests.llm.data import documents, empty, odd

# --- WARC ---


def page_rows(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in ("payload", "record_type", "_digest", "_salt", "archive", "host", "nodes", "text")})


PAGES = [(1, "http://a/", "same"), (2, None, "same"), (5, "http://a/ x\r\n", "same"), (3, "u", None), (4, "u", ""), (6, "u", "ü" * 300_000), (6, "u", "ü" * 300_000), (7, "u", "own"), (None, "u", "same"), (None, "u", "alone")]


def brute_warc(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        of = best.get(h or "")
        revisit = of is not None and i != of
        out[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", of if revisit else None] += 1
    return out


def test_warc_round_trip(spark, sf):
    for pages in (spark.read.parquet(f"{sf}/pages.parquet"), page_rows(spark, PAGES), page_rows(spark, [])):
        rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
        got = warc.round_trip(pages).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_warc(rows)


def test_warc_least_bytes_and_payloads(spark, tmp_path):
    pages = page_rows(spark, PAGES)
    path = f"file://{tmp_path}/w"
    listed = warc.write(pages, path, min_bytes=5)
    got = warc.read(listed, path).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}
    assert Counter(bytes(r.payload) for r in got if r.payload is not None and r.payload_bytes < 10) == Counter((h or "").encode() for _, _, h in PAGES if len(h or "") < 10)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%20x%0D%0A"}


def archive(n=200):
    records = [warc.render(warc.Record("response", f"urn:page:{i}", "http://x/", 0, warc.digest(p), p, None)).replace(b"Content-Length: 0\r\n\r\n", b"Content-Length: %d\r\n\r\n" % len(p)) for i in range(n) for p in [b"<p>hello %d</p>" % i * 9]]
    # The outer Content-Length counts the inner header, which has grown by its digits.
    fixed = []
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        fixed.append(re.sub(rb"Content-Length: \d+", b"Content-Length: %d" % (len(rest) - 4), head) + b"\r\n\r\n" + rest)
    out = io.BytesIO()
    warc.write_archive(fixed, out)
    return fixed, out.getvalue()


def test_warc_frames_and_dictionary():
    records, data = archive()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert list(warc.read_frames(io.BytesIO(data))) == records
    few, small = archive(2)
    assert small[:4] == warc.ZSTD_MAGIC and list(warc.read_frames(io.BytesIO(small))) == few
    assert list(warc.read_frames(io.BytesIO(b""))) == []
    for cut in (3, 20, len(data) - 1, len(data) // 2):
        with pytest.raises(ValueError):
            list(map(warc.parse, warc.read_frames(io.BytesIO(data[:cut]))))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X-Date"), (b"Content-Type: application", b"broken"), (b"sha1:", b"md5:"), (b"hello", b"hullo"), (b"hello", b"hell"), (b"HTTP/1.1", b"SPDY"), (b"\r\n\r\n<p>", b"\r\nContent-Length: 1\r\n\r\n<p>")],
)
def test_warc_rejects_wrong_records(old, new):
    good = archive(2)[0][0]
    assert warc.parse(good).kind == "response"
    with pytest.raises(ValueError):
        warc.parse(good.replace(old, new, 1))


# --- GIF ---


def slow_lzw(data, size):
    clear = 1 << size
    bits, at, out, width = int.from_bytes(data, "little"), 0, b"", size + 1
    table, before = [bytes([i]) for i in range(clear)] + [b"", b""], None
    while at + width <= len(data) * 8:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = table[: clear + 2], size + 1, None
            continue
        if code == clear + 1:
            break
        s = table[code] if code < len(table) else before + before[:1]
        out += s
        if before is not None and len(table) < 4096:
            table.append(before + s[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        before = s
    return out


def test_lzw():
    rng = random.Random(3)
    for size in (2, 3, 8, 8, 8):
        for n in (0, 1, 2, 300, 9000):
            for alphabet in (1, 2, 1 << size):
                data = bytes(rng.choices(range(alphabet), k=n))
                stream = gif.lzw_encode(data, size)
                assert slow_lzw(stream, size) == data == gif.lzw_decode(stream, size, n)
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\x00\xff\xff\xff", 8, 10)


def picture(frames, palette=bytes(range(12)), screen=(4, 4)):
    """A GIF of four colours. frames: (left, top, width, height, samples, disposal, transparent, delay, interlaced, own palette)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *screen, 0x81, 0, 0) + palette + b"\x21\xfe\x03abc\x00"
    for left, top, w, h, samples, disposal, transparent, delay, interlaced, own in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), delay, max(transparent, 0)) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x40 if interlaced else 0) | (0x81 if own else 0)) + (own or b"") + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def shown(data):
    return [(f.start_ms, f.delay_ms, f.canvas.copy()) for f in gif.decode_gif(data)]


def test_gif_disposal_transparency_interlace_palettes():
    full = [1] * 16
    base = (0, 0, 4, 4, full, 1, -1, 5, False, None)
    hole = (1, 1, 2, 2, [2, 3, 3, 2], 2, 3, 7, False, None)
    last = (0, 0, 1, 1, [0], 1, -1, 0, False, bytes([9] * 12))
    a, b, c = shown(picture([base, hole, last]))
    assert [(x[0], x[1]) for x in (a, b, c)] == [(0, 50), (50, 70), (120, 0)]
    assert (a[2][..., 0] == 3).all() and b[2][1, 1, 0] == 6 and b[2][1, 2, 0] == 3
    assert c[2][1, 1, 3] == 0 and c[2][0, 0, 0] == 9 and c[2][3, 3, 0] == 3
    _, d, e = shown(picture([base, (*hole[:5], 3, 3, 7, False, None), last]))
    assert d[2][1, 1, 0] == 6 and e[2][1, 1, 0] == 3
    rows = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4
    (f,) = shown(picture([(0, 0, 4, 4, rows, 1, -1, 0, True, None)]))
    assert f[2][:, 0, 0].tolist() == [0, 6, 3, 9]


def test_gif_that_is_broken(spark):
    good = picture([(0, 0, 4, 4, [1] * 16, 1, -1, 5, False, None)])
    media = [good, good[:-30], b"GIF", b"", None, good.replace(b"GIF89a", b"JPEG89"), good[:-1]]
    rows = gif.read(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in enumerate(media)], "k int, media binary")).orderBy("k").collect()
    assert [r.error is None for r in rows] == [True] + [False] * 6
    assert rows[0].frames[0].red == [16] + [0] * 7 and rows[6].frames[0].delay_ms == 50


def test_gif_store(spark, sf):
    for docs in (documents(spark, sf), odd(spark), empty(spark)):
        want = Counter()
        for r in docs.collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
        rows = gif.read(gif.store(docs)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
        assert all(r.error is None and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and sum(sum(f.red) for f in r.frames) >= r.payload_bytes for r in rows)


def drawn(payload):
    """By brute force: each frame's histogram of the screen, over which frames of 64 rows are drawn from the top."""
    chunks = [payload[i : i + 576 * 64] for i in range(0, len(payload), 576 * 64)]
    screen, out = list(chunks[0]), []
    for c in chunks:
        screen[: len(c)] = c
        out.append([sum(v // 32 == k for v in screen) for k in range(8)])
    return out


def test_gif_histograms_and_feature(spark, sf):
    docs = documents(spark, sf).orderBy(F.desc("n_chars")).limit(3).union(documents(spark, sf).limit(20))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, "q" * (576 * 64)), (-2, "r" * (576 * 64 + 1)), (-3, ""), (-4, None)], "doc_id long, text string"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    want = {i: drawn(t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))) for i, t in texts.items()}
    for r in gif.read(gif.store(docs)).collect():
        assert [f.red for f in r.frames] == [f.green for f in r.frames] == [f.blue for f in r.frames] == want[r.doc_id]
        assert [(f.frame, f.start_ms, f.delay_ms) for f in r.frames] == [(k, k * 10 * gif.DELAY_CS, 10 * gif.DELAY_CS) for k in range(len(want[r.doc_id]))]
    assert max(map(len, want.values())) > 1
    features = {r.doc_id: r.feature for r in queries.op6_gif(spark, sf).filter(F.col("doc_id").isin([i for i in texts if i >= 0])).collect()}
    red = lambda frames: ",".join(str(sum(f[k] for f in frames)) for k in range(8))
    assert features == {i: f"frames={len(f)};red={red(f)}" for i, f in want.items() if i >= 0}


# --- HTML ---


def article(html):
    """The text of the tables' pages, by their notation."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r'<div class="ad">.*?</div>|<script.*?</script>|<!--.*?-->', "", inner, flags=re.S)
    blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_pages(spark, sf):
    rows = queries.op8_html_extraction(spark, sf).collect()
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


HTML = """<html><body><div class=header-top>no</div><header>no</header><main><article><header><h1>T&amp;t</h1></header>
<p>a <b>b<p>c<i>d</i>e<br>f <span class="ad">no<div>no</div></span> g&nbsp;&eacute;<ul><li>x<li>y</ul><aside>no</aside><div id="comments"><p>no</p></div>
<form><input value=no>no</form><table><tr><td>1<td>2</table><!-- no > --><script>if(a<b){"</p>"}</script><style>no</style>5 < 6 &lt;b&gt;<p>z</article></main><footer>no</footer>no"""


def test_notation():
    assert sitetree.main_text("http://h/", HTML, set()).split("\n") == ["T&t", "a b", "cde f g é", "x", "y", "1", "2", "5 < 6 <b>", "z"]
    for text in ("", "<", "<p", "</", "<a href='x", "<!--", "<script>", "a<b", "</p></p></div>", "<p>" * 3000, "<div" * 300):
        sitetree.main_text(None, text, set())
    assert sitetree.main_text(None, None, set()) == ""


def test_hosts(spark):
    urls = [("HTTPS://u:p@Ex.Ample.:80/p", "ex.ample"), (" //a.b/c", "a.b"), ("a.b/c", ""), ("", ""), (None, "")]
    df = spark.createDataFrame(urls, "url string, want string")
    assert [r.got for r in df.select(sitetree.host(df.url).alias("got")).collect()] == [w for _, w in urls]


def test_classes_of_the_page_are_not_noise():
    for page in ("<html class=has-menu><body class='single has-sidebar' id=page-comments>%s</body>", "<body><article class='post has-comments'>%s</article>", "<main class='related'>%s</main>"):
        assert sitetree.main_text("http://h/", page % "<p>own</p><div class=sidebar>no</div><nav>no</nav>", set()) == "own"
    assert sitetree.main_text("http://h/", "<body class=x><div class=has-sidebar><p>no</p></div>", set()) == ""


def site(n, host):
    return [(i, f"http://{host}/{i}", f"<body><div class=top><p>Same words</p></div><div class=text><p>Own text {i} of {host}</p><p>More {i * 7}</p></div><div class=low><p>Same end</p></div></body>") for i in range(n)]


def test_style_tree_removes_what_repeats(spark):
    pages = page_rows(spark, site(6, "a.x") + site(2, "b.x") + [(99, None, None), (98, "", "<p>x</p>"), (None, "http://c/", "<p>q</p>")])
    for nodes in (sitetree.BROADCAST_NODES, 0):
        got = sitetree.extract(pages, nodes).collect()
        by = Counter((r.url, r.text) for r in got)
        assert len(got) == 11
        assert by["http://a.x/3", "Own text 3 of a.x\nMore 21"] == 1
        assert by["http://b.x/1", "Same words\nOwn text 1 of b.x\nMore 7\nSame end"] == 1
        assert by[None, ""] == 1 and by["", "x"] == 1
    assert sitetree.extract(page_rows(spark, [])).count() == 0


PARTS = {"top": "div.top", "menu": "div.m", "text": "div.t", "ad": "div.x", "end": "div.end"}


def unlabelled(n, host, pool=3):
    """Pages without an article, whose menu, advert and end are plain divs with classes that say nothing."""
    out = []
    for i in range(n):
        text = "".join(f"<p>Own text {i} {k} of {host}</p>" for k in range(1 + i % 3))
        out.append((i, f"http://{host}/{i}", f"<body><div class=m><span>Home and away</span></div><div class=x><p>Buy {i % pool}</p></div><div class=t>{text}</div><div class=end>Since 1999</div></body>"))
    return out


def test_the_tree_decides_where_nothing_is_labelled(spark):
    pages = page_rows(spark, unlabelled(30, "u.x", 2))
    want = {i: "\n".join(f"Own text {i} {k} of u.x" for k in range(1 + i % 3)) for i in range(30)}
    assert {r.page_id: r.text for r in sitetree.extract(pages).collect()} == want
    without = {i: sitetree.main_text("u.x", html, frozenset()) for i, _, html in unlabelled(30, "u.x", 2)}
    assert all(without[i] == f"Home and away\nBuy {i % 2}\n{want[i]}\nSince 1999" for i in want)
    # Copies of one page say nothing about its paths, and two pages are too few.
    for rows in ([unlabelled(1, "u.x")[0]] * 30, unlabelled(2, "u.x")):
        got = sitetree.extract(page_rows(spark, rows)).collect()
        assert len(got) == len(rows) and all("Home and away" in r.text and "Since 1999" in r.text for r in got)


def test_importances_against_a_tree(spark):
    """Entropies by their definition, over dictionaries, on pages written from paths and texts."""
    pages = unlabelled(17, "a.x") + unlabelled(5, "b.x", 1) + site(6, "c.x") + [unlabelled(17, "a.x")[3]]
    tree = {}
    for url, html in {(u.split("/")[2], h) for _, u, h in pages}:
        blocks, styles = sitetree.parse(html, url)
        of = dict(styles)
        for b in blocks:
            tree.setdefault(b.node, ({}, []))[1].append(b.text)
            tree[b.node][0][html] = of[b.node]

    def entropy(values):
        total = len(values)
        return 1.0 if total < 2 else -sum(n / total * math.log(n / total) for n in Counter(values).values()) / math.log(total)

    want = {node: (len(looks), 0.1 * entropy(list(looks.values())) + 0.9 * entropy(texts)) for node, (looks, texts) in tree.items()}
    got = {r.node: (r.pages, r.importance) for r in sitetree.importances(page_rows(spark, pages)).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    node = lambda *parts: functools.reduce(sitetree._hash, parts, sitetree._hash("a.x"))
    assert {node("body", "div.m"), node("body", "div.x", "p"), node("body", "div.t", "p"), node("body", "div.end")} <= set(got)
    assert got[node("body", "div.m")][1] == 0 and got[node("body", "div.t", "p")][1] > 0.89
    low = {r.node for r in sitetree.low_nodes(page_rows(spark, pages)).collect()}
    assert low == {k for k, (n, x) in want.items() if n >= sitetree.LEAST_PAGES and x < sitetree.LOW}


def test_deep_markup_takes_memory_in_proportion():
    deep = "<div>" * 90_000 + "text" + "</p></i></li>" * 30_000 + "<b>" * 30_000 + "<p>x</p>" * 20_000
    tracemalloc.start()
    blocks, styles = sitetree.parse(deep, "h")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(deep) > 1_000_000 and len(blocks) == 20_001 and len(styles) == 110_000 and peak < 200e6
