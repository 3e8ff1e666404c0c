from lexarium.llm import html_text as h

CASES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three</p><p>Fo<b>ur</b></article><footer>F</footer></body></html>": "A & B\nOne two three\nFour",
    '<body><div class="cookie-banner">We use cookies</div><main><p>Text of the page that is long enough.</p><div class="ad">Buy</div><form><p>Your name</p><button>Go</button></form><p>End.</p></main><aside>Side</aside>': "Text of the page that is long enough.\nEnd.",
    '<div id="page"><div class="post-content"><p>First paragraph with words in it.<p>Second paragraph, unclosed<ul><li>item one<li>item two</ul></div><section id="comments"><p>Nice post, thank you very much indeed!</p></section></div>': "First paragraph with words in it.\nSecond paragraph, unclosed\nitem one\nitem two",
    "<article><p>a &lt;b&gt; &#233; &eacute; &nbsp; x</p><!-- gone <p>not</p> --><script>if (a < b) { '<p>no</p>' }</script><style>p{}</style><p>5 < 6 and 7</p></article>": "a <b> é é x\n5 < 6 and 7",
    "": "", "just text": "just text", "<p>": "", "<div><p>cut off in <b": "cut off in",
    '<article><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table><pre>k\n  l</pre></article>': "a b\nc d\nk l",
    '<body hidden><p>x</p></body><main><p style="display: none">no</p><p>yes</p></main>': "yes",
}


def test_cases():
    for source, want in CASES.items():
        assert h.extract(source, []) == want, source


def test_names_controls_and_sibling_articles():
    long = "A paragraph with quite a number of words in it, so that it counts as text of the page."
    assert h.extract(f'<body><article><p>{long}</p><div class="form-factor"><p>It is small.</p></div><div class="search-form"><p>Find</p></div><p>End.</p></article>', []) == f"{long}\nIt is small.\nEnd."
    assert h.extract(f"<article><p>{long}</p><p>Use <label>key</label> here and <button>press</button> it.</p><div><button>Share</button> <label>Name</label></div></article>", []) == f"{long}\nUse key here and press it."
    assert h.extract(f"<body><article><p>{long}</p></article><article><p>The second.</p></article><aside><article><p>no</p></article></aside>", []) == f"{long}\nThe second."
    assert [h._names_aside(n) for n in ("ad-slot", "related-posts", "header-image", "cookie-box", "comments", "adSlot", "story", "site-footer-wide")] == [True, True, False, True, True, True, False, True]


def test_article_text_stays_whatever_its_names_begin_with():
    long = "A paragraph with quite a number of words in it, so that it counts as text of the page."
    inside = '<div class="cookie-recipe"><p>Take some flour.</p></div><p class="navigation-systems">Stars and gyroscopes.</p><p class="comment-free">No remarks.</p><div class="alert alert-info"><p>Mind the step.</p></div>'
    assert h.extract(f"<body><article><p>{long}</p>{inside}</article></body>", []) == f"{long}\nTake some flour.\nStars and gyroscopes.\nNo remarks.\nMind the step."
    outside = '<div class="cookie-banner"><p>We use them.</p></div><ul class="nav-links"><li>Home</li></ul><div class="comment-thread"><p>First!</p></div><div role="alert"><p>Down today.</p></div><div id="newsletter-form"><p>Sign up.</p></div>'
    assert h.extract(f"<body><article><p>{long}</p>{outside}</article></body>", []) == long


def test_nine_templates_and_very_long_pages(spark):
    rows = []
    for k in range(9):
        for i in range(2 + (k < 8)):
            rows.append((3 * k + i, "http://a.example/x", page("".join(f"<p>Paragraph {j} of a text in template {k}.</p>" for j in range(5)), f"kind{'abcdefghi'[k]}")))
    # alone, the box would win on this page of the rarest template
    rows.append((100, "http://a.example/y", page("<p>tiny</p>", "kindi").replace("short note below the text", "a longer note that says more than the text does")))
    rows.append((200, "http://b.example/long", page("<p>many words of a long page</p>" * 60_000)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.main_text(pages).collect()}
    assert got[100] == "tiny"
    assert got[200].count("\n") == 59_999


def test_paths_with_equal_votes_come_by_name(spark):
    rows = [(i, "http://a.example/", f"<body><div class={c}><p>{'same text ' * 9}</p></div>") for i, c in enumerate("bbaa")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert h.winning_paths(pages).first()["paths"] == ["body/div.a", "body/div.b"]


def page(body, css="entry"):
    return f'<html><body><div class="menu"><a href="/">x</a></div><div class="{css}">{body}</div><div class="box"><p>short note below the text</p></div></body></html>'


def test_hosts_vote(spark):
    long = "".join(f"<p>Paragraph {i} with a number of words in it.</p>" for i in range(6))
    rows = [(i, f"http://a.example/{i}", page(long, f"entry{i}")) for i in range(5)]
    # alone, the box would win on this page; its host knows better
    rows.append((9, "http://a.example/9", page("<p>tiny</p>", "entry9").replace("short note below the text", "a longer note that says more than the text does")))
    rows += [(10, None, page(long)), (11, "http://b.example", None), (12, "nonsense", ""), (None, "http://a.example/1", page(long))]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in h.main_text(pages).collect()}
    assert len(got) == len(rows)
    assert got[9]["text"] == "tiny" and got[0]["text"].count("\n") == 5 and got[10]["text"] == got[None]["text"] == got[0]["text"]
    assert got[11]["text"] == "" == got[12]["text"] and got[11]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert h.main_text(pages.limit(0)).count() == 0
    h.MAX_BROADCAST_ROWS, kept = 0, h.MAX_BROADCAST_ROWS
    try:
        again = {r["page_id"]: r for r in h.main_text(pages).collect()}
    finally:
        h.MAX_BROADCAST_ROWS = kept
    assert again == got
