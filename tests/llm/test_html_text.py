from cohortlab.llm import html_text

PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>'
    '<div class="ad">Buy this thing now, it is cheap and good.</div><div class="post p12"><header>Top</header><h1>A &amp; B</h1>'
    "<p><b>First  paragraph<br>with some words in it.<p>Second <i>para</i>graph, also with words.</div>"
    '<div class="comments"><p>nice article, I really liked to read it all day</p></div><footer>&copy; x</footer></body></html>'
)
SHORT = '<body><div class="post p7"><p>Tiny.</p></div><div class="other"><p>This text is no article but it is longer.</p></div></body>'
TEXT = "A & B\n\nFirst paragraph with some words in it.\n\nSecond paragraph, also with words."


def test_article_text_and_consensus_of_the_host(spark):
    rows = [(i, f"https://h.example/{i}", PAGE, 1) for i in range(4)]
    rows += [(9, "https://h.example/short", SHORT, 1), (10, None, None, 1), (11, "https://x.example", "", 1)]
    rows += [(12, "//y.example/a", "<p>only a text, without any container", 1), (0, "https://h.example/0", PAGE, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int").repartition(3)
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[0] == text[3] == TEXT
    assert text[9] == "Tiny."  # alone, the page would be taken for its longer container
    assert text[10] == text[11] == ""
    assert text[12] == "only a text, without any container"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_broken_markup_ends():
    for html in ("<" * 5_000, '<a "' * 2_000, "<div>" * 3_000 + "x", "<!-- never closed", "<script>never closed", "</p></div>a"):
        html_text.Page(html).best()


def test_attributes_are_read_by_whole_names():
    for tag in (
        '<div style="overflow:hidden">',
        '<div aria-hidden="false">',
        '<div title="The hidden valley">',
        "<div data-role=navigation data-class='ad'>",
        "<div title='class=ad role=menu'>",
        "<div title=it's class=post>",
        '<div title=a"b class = "post">',
        '<div class=post class=ad>',
        "<div/title=it's>",
    ):
        page = html_text.Page(f"<body>{tag}<p>It's the article's text.</p></div><p title='x'>End</body>")
        assert [text for _, text, _ in page.blocks] == ["It's the article's text.", "End"], tag
    for tag in ("<div hidden>", "<div class=a HIDDEN=''>", "<div\nROLE = 'navigation'>", '<div title="a > b" class="x ad">', "<div id=sidebar>"):
        page = html_text.Page(f"<body>{tag}<p>furniture</p></div><p>text</body>")
        assert [text for _, text, _ in page.blocks] == ["text"], tag
    assert html_text.Page("<p title=\"never closed>text").blocks[0][1] == "text"


def _words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def _page(article):
    return f"<body><nav><a href=/>Home</a> <a href=/n>News of the day</a></nav>{article}<footer>Imprint and contact</footer></body>"


def test_articles_are_found_whole():
    title, lead, body = _words("title", 4), _words("lead", 40), _words("body", 60)
    comments = f'<div class="comments"><p>{_words("comment", 500)}</p></div>'
    whole = f"{title}\n\n{lead}\n\n{body}"
    for article in (
        f'<article><h1>{title}</h1><div class="top">{lead}</div><div class="body">{body}</div></article>',
        f'<article><h1>{title}</h1><p>{lead}</p><div class="body"><p>{body}</p></div></article>',
        f'<article><h1>{title}</h1><p>{lead}</p><div class="body"><p>{body}</p></div>{comments}</article>',
        f'<div class="post"><h1>{title}</h1><p>{lead}</p><div class="body"><p>{body}</p></div>{comments}</div>',
        f'<div class="post"><div><div><h1>{title}</h1></div></div><div><div><p>{lead}</p></div></div><div><div><p>{body}</p></div></div></div>',
    ):
        page = html_text.Page(_page(article))
        assert page.text(page.best()[0]) == whole, article
    beside = html_text.Page(_page(f'<div class="box"><a href=/x>{_words("other", 30)}</a></div><div class="post"><p>{body}</p></div>'))
    assert beside.text(beside.best()[0]) == body


def test_votes_by_layout_and_without_host(spark):
    news = _page(f'<div class="box"><p>{_words("box", 10)}</p></div><article><p>{_words("news", 80)}</p></article>')
    wiki = _page(f'<article><p>{_words("box", 10)}</p></article><div class="wiki"><p>{_words("wiki", 50)}</p></div><ul><li><a>{_words("more", 60)}</a></ul>')
    rows = [(i, f"https://h.example/{i}", news) for i in range(5)] + [(10 + i, f"https://h.example/w{i}", wiki) for i in range(3)]
    rows += [(20 + i, None, news) for i in range(5)] + [(30, None, _page(f'<div class="wiki"><p>{_words("wiki", 50)}</p></div><article><nav>{_words("menu", 9)}</nav><p>{_words("box", 3)}</article>'))]
    text = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(text) == len(rows)
    assert all(_words("news", 80) in text[i] for i in (0, 4, 20, 24))
    assert all(_words("wiki", 50) in text[i] for i in (10, 12, 30))
