from __future__ import annotations

from bulwark.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note --><div class="ad">Buy</div>
<article><h1>T &amp; &copy; x</h1><p><b>First&nbsp;  one.<br>two <p>Third <i>part</i></p><aside>side</aside><div class="share-links">s</div><table><tr><td>c1<td>c2</table></article>
<div id="comments"><p>Nice</p></div><form>f<input></form><footer>&copy; foot"""


def content(page):
    return [t for z, t in h.blocks_of(page) if z == h.CONTENT]


def test_article():
    assert content(PAGE) == ["T & © x", "First one. two", "Third part", "c1", "c2"]
    assert h.blocks_of(None) == [] and h.blocks_of("") == []


def test_zones():
    got = h.blocks_of('<body class="has-ads"><div id="top-nav">x</div><p>Hi <span class="ad">no <span>q</span></span> you<p class="notice">n<p>b<li>d')
    assert [t for z, t in got if z == h.OPEN] == ["Hi", "you", "b", "d"]
    assert content("<main><header><h1>T</h1></header><p>a<nav>n</nav>b</main><header>h</header>") == ["T", "a", "b"]


def test_broken_markup():
    assert [t for _, t in h.blocks_of("a < b &am; <p class='x>y</p><b>z")]
    assert [t for _, t in h.blocks_of("<" * 2000)]
    assert content("<article>" + "<div>" * 3000 + "deep") == ["deep"]


def brute_cover(streams, pages, n, least):
    seen = {}
    for s, p in zip(streams, pages, strict=True):
        for i in range(len(s) - n + 1):
            seen.setdefault(tuple(s[i : i + n]), set()).add(p)
    out = []
    for s in streams:
        mask = [False] * len(s)
        for i in range(len(s) - n + 1):
            if len(seen[tuple(s[i : i + n])]) >= least:
                mask[i : i + n] = [True] * n
        out.append(mask)
    return out


def test_suffix_array_equals_brute_force():
    import random

    rng = random.Random(6)
    for n in (2, 3, 4, 5, 7):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(12)]
        pages = [k // 2 for k in range(12)]
        assert [m.tolist() for m in h.covered(streams, pages, n, 3)] == brute_cover(streams, pages, n, 3)
    assert h.covered([[], []], [0, 1])[0].tolist() == []


def test_boilerplate_of_pages_without_article(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP_PAGES", 8)
    page = "<body><p>Welcome to the best site of all sites</p><p>Story number {0} tells of thing {0} at length</p><p>All rights belong to somebody else here</p>"
    rows = [(k, f"https://one.example/{k}", page.format(f"w{k}"), "x") for k in range(20)]
    rows += [(100, None, None, "x"), (101, "nonsense", "<p>lone</p>", "x"), (101, "nonsense", "<p>lone</p>", "x"), (None, "https://a.example/", "<article>é 😀</article>", "x")]
    got = h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is not None and r.page_id < 100:
            assert r.text == f"Story number w{r.page_id} tells of thing w{r.page_id} at length"
        assert r.n_chars == len(r.text)
    assert {r.text for r in out if r.page_id in (100, 101, None)} == {"", "lone", "é 😀"}
    assert h.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_phrases_stay_in_open_prose(spark):
    notice = "Subscribers of this site may read every story in full " * 4
    story = "<p>Visitor w{0} came at the end of the day and as a result of it w{0} left on the other hand w{0} stayed</p>"
    rows = [(k, f"https://one.example/{k}", f"<body>{story.format(k)}<p>start w{k} {notice} w{k} stop</p><p>All rights belong to somebody else</p>") for k in range(12)]
    for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        assert r.text == story.format(k)[3:-4] + f"\nstart w{k} w{k} stop"


def test_repeats_across_parts_of_a_host(spark, monkeypatch):
    notice = " ".join(f"word{j}" for j in range(40))
    rows = [(k, f"https://one.example/{k}", f"<p>own w{k} {notice if k % 12 == 0 else ''} w{k} end</p><p>a short line of {k % 20}</p>") for k in range(60)]
    rows += [(0, *rows[0][1:])] * 2 + [(70, "https://two.example/", f"<p>{notice}</p>"), (None, "https://one.example/n", "<p>a line on one null page</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(str, h.main_texts(df).collect()))
    monkeypatch.setattr(h, "GROUP_PAGES", 4)
    got = h.main_texts(df).collect()
    assert sorted(map(str, got)) == whole
    assert {r.text for r in got if r.page_id is not None and r.page_id < 60} == {f"own w{k} w{k} end" for k in range(60)}
    assert {r.text for r in got if r.page_id == 70} == {notice}


def test_elements_without_an_end_and_names_in_articles():
    assert content("<article><p>a</p><svg/><p>b</p><iframe/><p>c</p><object><p>d</p></article>") == ["a", "b", "c", "d"]
    assert content("<article><p>a</p><svg><path/><text>no</text></svg><p>b</p></article>") == ["a", "b"]
    kept = '<div class="social-history">x</div><div class="article-header"><h1>T</h1></div><div id="alerts-1990">y</div><p class="noticeable">z</p>'
    assert content(f"<article>{kept}</article>") == ["x", "T", "y", "z"]
    gone = '<div class="social-links">x</div><div class="related">r</div><div id="site-menu">m</div><p class="top notice">n</p><div class="ad-slot">a</div>'
    assert content(f"<article>{gone}<p>t</p></article>") == ["t"]


def test_long_broken_pages_take_linear_time():
    import time

    began = time.time()
    for part in ("<p a='b ", "<svg>", "<!--", '<p a="', "</", "<p", "<textarea>", "<article><p>x", "<b><i>"):
        h.blocks_of(part * 20_000)
    assert time.time() - began < 5


def brute_texts(rows):
    """The whole query in plain Python: windows and whole blocks compared as they are, host by host."""
    parsed = [(i, url, h.blocks_of(html)) for i, url, html in rows]
    windows, wholes = {}, {}
    for i, url, blocks in parsed:
        host = (url or "").split("/")[2] if "//" in (url or "") else ""
        for zone, text in blocks:
            tokens = text.split()
            if zone != h.CONTENT:
                for k in range(len(tokens) - h.MIN_TOKENS + 1):
                    windows.setdefault((host, tuple(tokens[k : k + h.MIN_TOKENS])), set()).add(i)
                if len(tokens) >= h.MIN_BLOCK:
                    wholes.setdefault((host, text), set()).add(i)
    out = []
    for i, url, blocks in parsed:
        host = (url or "").split("/")[2] if "//" in (url or "") else ""
        keep = [text for zone, text in blocks if zone == h.CONTENT]
        if not keep:
            for zone, text in blocks:
                tokens = text.split()
                gone = [len(wholes.get((host, text), ())) >= h.MIN_PAGES] * len(tokens)
                for k in range(len(tokens) - h.MIN_TOKENS + 1):
                    if len(windows[host, tuple(tokens[k : k + h.MIN_TOKENS])]) >= h.MIN_PAGES:
                        gone[k : k + h.MIN_TOKENS] = [True] * h.MIN_TOKENS
                if zone == h.OPEN and (rest := " ".join(t for t, g in zip(tokens, gone, strict=True) if not g)):
                    keep.append(rest)
        out.append((i, "\n".join(keep)))
    return sorted(out)


def test_whole_query_equals_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, lines = [some(rng.randint(25, 60)) for _ in range(6)], [some(rng.randint(2, 8)) for _ in range(8)]
    rows = []
    for k in range(150):
        blocks = [f"{some(rng.randint(0, 9))} {rng.choice(shared) if rng.random() < 0.4 else ''} {some(rng.randint(1, 30))}" for _ in range(rng.randint(1, 4))]
        blocks += [rng.choice(lines)] * (rng.random() < 0.6) + [f"</p><nav>{rng.choice(lines)}</nav><p>"] * (rng.random() < 0.3)
        body = "".join(f"<p>{b}</p>" for b in blocks)
        rows.append((k, f"http://h{k % 4}.example/{k}" if k % 10 else None, f"<article>{body}</article><p>{some(3)}</p>" if k % 5 == 0 else f"<body>{body}"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = brute_texts(rows)
    for group in (256, 7):
        monkeypatch.setattr(h, "GROUP_PAGES", group)
        assert sorted((r.page_id, r.text) for r in h.main_texts(df).collect()) == want
