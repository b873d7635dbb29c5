import pytest

from coppice.llm import chat as C
from coppice.llm import html as H

SHELL = (
    "<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<div id=cookie-notice>We use cookies</div><nav><ul><li><a href=/a>Menu {0}</a></li></ul></nav>"
    "<div class='ad top'>Buy {0}</div>{1}<aside><p>Side</p></aside><footer>&copy; site {0}</footer></body></html>"
)


def read(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in H.extract_text(df).collect()}


def test_main_text(spark):
    article = "<article><h1>Head &amp; tail</h1><p>One\n two<br>three<p>Four &lt;5&gt; <b>six<script>x()</script></article>"
    plain = "<div class=content><p>First here.</p><ul><li>item</ul><form><input><p>Name</p></form><p>Last &nbsp; here</div>"
    inner = "<main><p>Text</p><section class='comments'><p>first!</p><div>x</div></section><!-- no --><p>More</p></main>"
    pages = [("http://a.x/1", SHELL.format(i, article)) for i in range(4)]
    pages += [("http://b.x/1", SHELL.format(i, plain)) for i in range(3)]
    pages += [("http://c.x/", SHELL.format(0, inner)), (None, None), ("http://a.x/z", ""), ("bad url", "just <text"), ("http://a.x/2", "<article><p>cut off")]
    got = read(spark, pages)
    assert all(got[i].text == "Head & tail\n\nOne two three\n\nFour <5> six" for i in range(4))
    assert all(got[i].text == "First here.\n\nitem\n\nLast here" for i in range(4, 7))
    assert got[7].text == "Text\n\nMore"
    assert [got[i].text for i in (8, 9, 11)] == ["", "", "cut off"] and got[10].text.startswith("just")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert read(spark, [])== {}


NEUTRAL = (
    "<html><body><header class=top><div class=name>The Daily Thing</div><div>All the news since 1901</div></header>"
    "<div class=strip>This site is written by its readers and read by its writers.</div>{}<div class=end>Made in Nowhere</div></body></html>"
)


def test_template_text_is_left_out(spark):
    body = "<p>Body {0} of this page.</p><div>More of {0}</div><p>Filed under news</p>"
    pages = [(f"http://a.x/{i}", NEUTRAL.format("<article>" + body.format(i) + "</article>")) for i in range(4)]
    pages += [(f"http://b.x/{i}", NEUTRAL.format("<div class=text>" + body.format(i) + "</div>")) for i in range(4)]
    got = read(spark, pages)
    assert [got[i].text for i in range(8)] == [f"Body {i % 4} of this page.\n\nMore of {i % 4}\n\nFiled under news" for i in range(8)]
    copies = read(spark, [("http://c.x/", pages[0][1])] * 3 + [("http://d.x/", pages[0][1])])
    assert all(r.text == "Body 0 of this page.\n\nMore of 0\n\nFiled under news" for r in copies.values())


def test_an_article_keeps_what_repeats_and_what_only_sounds_like_boilerplate(spark):
    """However many neighbours a page has."""
    recipe = "<article><h1>Dish {0}</h1><h2>Ingredients</h2><p>Flour {0}</p><h2>Method</h2><p>Bake {0}</p></article>"
    report = "<article><h1>Market</h1><div class='share-price'>Up {0}</div><section class='social-history'>Of {0}</section><div class='share-buttons'>Tell</div><p>End.</p></article>"
    teaser = "<article class=x><p>Read our best stories</p></article><article><p>Own {0}</p></article>"
    for n in (1, 2, 4, 6):
        pages = [(f"http://{h}.x/{i}", NEUTRAL.format(x.format(i))) for h, x in zip("abc", (recipe, report, teaser), strict=True) for i in range(n)]
        got = read(spark, pages)
        assert [got[i].text for i in range(n)] == [f"Dish {i}\n\nIngredients\n\nFlour {i}\n\nMethod\n\nBake {i}" for i in range(n)]
        assert [got[n + i].text for i in range(n)] == [f"Market\n\nUp {i}\n\nOf {i}\n\nEnd." for i in range(n)]
        assert n < 3 or [got[2 * n + i].text for i in range(n)] == [f"Own {i}" for i in range(n)]


def test_articles_come_from_the_slots_of_neutral_hosts(spark):
    """Hosts whose names tell nothing: the article is known, only the template can find it."""
    import random

    rng, pages, expected = random.Random(8), [], []
    for h in range(12):
        first, last = [f"<div class=k{rng.randrange(9)}>Fixed {h} {k}</div>" for k in range(2)]
        holder = rng.choice(["<div class=q{0}>{1}</div>", "<section>{1}</section>", "<div><div class=z>{1}</div></div>", "{1}"])
        for i in range(rng.randint(3, 6)):
            texts = [f"Opening {h} {i}", *rng.sample(["Ingredients", f"Words of {h} and {i}", f"More {i} {h}", "Filed alike"], 3), f"Ending {i} {h}"]
            body = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>"]).format(t) for t in texts)
            pages.append((f"http://h{h}.x/{i}", f"<html><body>{first}<p>Strip {h}</p>{holder.format(h, body)}<p>Tail {h}</p>{last}</body></html>"))
            expected.append("\n\n".join(texts))
    got = read(spark, pages)
    assert [got[i].text for i in range(len(pages))] == expected
    assert all(H.main_text(page, None) != text for (_, page), text in zip(pages, expected, strict=True))  # without the template


def test_boilerplate_inside_the_article_ends_at_its_own_tag(spark):
    article = "<article><h1>Head {0}</h1><div class='share'>Tell all</div><p>Body {0}</p><div class='fig'>Figure {0}</div></article>"
    before = "<html><body><div class='x'>Other</div>{}<div>End</div></body></html>"
    got = read(spark, [(f"http://a.x/{i}", before.format(article.format(i))) for i in range(4)])
    assert [got[i].text for i in range(4)] == [f"Head {i}\n\nBody {i}\n\nFigure {i}" for i in range(4)]


def test_template_tags_still_part_blocks_and_words(spark):
    got = read(spark, [("http://a.x/", "<article><h1>Title</h1><p>Body</p></article>"), ("http://b.x/", "<main><p>one<br>two</p></main>")])
    assert (got[0].text, got[1].text) == ("Title\n\nBody", "one two")


def test_templates_are_classes_of_equal_occurrence(spark):
    pages = [(f"http://a.x/{i}", SHELL.format(i, "<article>" + "<p>x</p>" * i + "</article>")) for i in range(1, 6)]
    df = spark.createDataFrame([(h, u) for u, h in pages], "html string, url string")
    from pyspark.sql import functions as F

    (row,) = H.templates(df.withColumn("_host", H.host_of(F.col("url"))), "html").collect()
    top = row.classes[0]
    assert "article" in top and "/article" in top and "p" not in top
    assert top.index("article") < top.index("/article") < top.index("/footer")


def brute_templates(pages):
    """Classes by host from plain dictionaries: tokens of equal vectors, largest support first."""
    hosts = {}
    for url, page in pages:
        hosts.setdefault(url.split("/")[2], []).append(page)
    found = {}
    for host, texts in hosts.items():
        counts = [[s for t in H.parse(p) if (s := H.signature(*t)) is not None] for p in texts]
        classes = {}
        for token in {s for c in counts for s in c}:
            vector = tuple(c.count(token) for c in counts)
            on = [texts[i] for i, n in enumerate(vector) if n]
            text = token.startswith('"')
            if len({n for n in vector if n}) > 1 or 2 * len(on) < len(texts):
                continue
            if text and (2 * len(on) == len(texts) or len(on) < 3 or len(set(on)) == 1):
                continue
            at = sum(c.index(token) for c in counts if token in c) / len(on)
            classes.setdefault((len(on), vector), []).append((at, token))
        found[host] = {(k[0], frozenset(t for _, t in v)) for k, v in classes.items()}
    return found


def test_templates_equal_brute_force(spark):
    from pyspark.sql import functions as F

    pages = [(f"http://a.x/{i}", SHELL.format(i % 3, "<article>" + "<p>x</p>" * (i % 2 + 1) + "<i>say</i><i>say</i></article>")) for i in range(7)]
    pages += [(f"http://b.x/{i}", NEUTRAL.format(f"<p>Body {i}</p>" + "<b>both</b>" * (i < 2))) for i in range(4)]
    pages += [("http://c.x/", NEUTRAL.format(""))]
    df = spark.createDataFrame([(h, u) for u, h in pages], "html string, url string")
    got = H.templates(df.withColumn("_host", H.host_of(F.col("url"))), "html").collect()
    sets = {r["_host"]: {frozenset(c) for c in r.classes} for r in got}
    assert sets == {h: {c for _, c in v} for h, v in brute_templates(pages).items()}


def test_text_that_repeats_on_a_page_can_be_the_templates():
    tokens = H.parse("<p>one</p><a>more</a><p>two</p><a>more</a>")
    assert H.skeleton(tokens, [["a", '"more', "/a"]]) == [3, 4, 5, 9, 10, 11]
    assert H.skeleton(tokens, [["a", "/a", '"more']]) == []


def test_site_headers_odd_quotes_and_words_in_names(spark):
    got = read(
        spark,
        [
            ("http://a.x/", "<body><header><p>Site head</p></header><div class=text><p>Body</p></div></body>"),
            ("http://b.x/", "<article><header><h1>Title</h1></header><p title=it's>Hello</p></article>"),
            ("http://c.x/", '<article><div class="side-by-side">Both</div><div class="side">Not</div><p a="x>y" b=\'>\'>In</p></article>'),
            ("http://d.x/", "<article><h1>Title</h1>Lead 0 text here</article>"),
            ("http://e.x/", '<div class="post"><header><h1>Own</h1></header><p x="open>Text</p></div>'),
        ],
    )
    assert [got[i].text for i in range(5)] == ["Body", "Title\n\nHello", "Both\n\nIn", "Title\n\nLead 0 text here", "Own\n\nText"]


def test_a_hot_host_is_dealt_out_and_rows_repeat(spark):
    pages = [(f"http://a.x/{i % 90}", NEUTRAL.format(f"<p>Body {i % 90}</p>")) for i in range(100)] + [("http://b.x/", "<p>" + "long " * 50_000 + "</p>")]
    got = read(spark, pages)
    assert [got[i].text for i in range(100)] == [f"Body {i % 90}" for i in range(100)] and got[100].n_chars == 249_999


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "http://a.x/", "<p>one</p>", 1), (None, None, None, 2)]
    df = spark.createDataFrame(rows, "page_id smallint, url string, html string, _host int").withColumnRenamed("_host", "classes")
    assert sorted((r.page_id, r.text) for r in H.extract_text(df).collect()) == [(None, ""), (None, "one")]


def test_slots_need_order_and_nesting():
    tokens = H.parse("<a1></a1><b1><c1></c1></b1>")
    assert H.skeleton(tokens, [["a1", "/a1", "b1", "/b1"], ["c1", "/c1"]]) == [0, 1, 2, 3, 4, 5]
    assert H.skeleton(tokens, [["b1", "a1"], ["c1"]]) == [3]
    assert H.skeleton(tokens, [["b1", "/b1"], ["a1", "c1"]]) == [2, 5]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "How do I reset the password of the portal?"),
        (1, 1, "assistant", "Open the settings.\nThen press reset and wait."),
        (1, 2, None, "> Then press reset and wait.\nThat fails."),
        (2, 0, "user", "> > How do I reset the PASSWORD of   the portal?\n> Open the settings.\n> Then press reset and wait.\nSame here"),
        (2, 1, "assistant", None),
        (3, 0, "user", "alone > not a quote"),
        (4, 0, "user", "> Same here\nshort quotes link alike"),
        (1, 2, None, "> Then press reset and wait.\nThat fails."),
    ]
    got = C.build_threads(messages(spark, rows).selectExpr("*", "0 as thread_id", "1 as level"))
    got = {(r.thread_id, r.position): r for r in got.collect()}
    assert len(got) == 8
    assert [got[1, k].conv_id for k in range(6)] == [1, 1, 1, 1, 2, 2]
    assert got[1, 2].text == "That fails." and (got[1, 2].parent_conv, got[1, 2].parent_turn) == (1, 1)
    assert got[1, 4].text == "Same here" and (got[1, 4].parent_conv, got[1, 4].parent_turn, got[1, 4].depth) == (1, 1, 1)
    assert got[1, 5].text == "" and got[1, 2].role == "user"
    assert got[3, 0].quotes == 0 and (got[1, 6].parent_conv, got[1, 6].depth) == (2, 2) and got[1, 6].text == "short quotes link alike"


def test_cycles_and_chains_of_conversations(spark):
    text = "the original words of conversation {}"
    rows = [(i, 0, "user", text.format(i) + (f"\n> {text.format(i - 1)}" if i else "")) for i in range(5)]
    rows += [(7, 0, "user", text.format(7) + "\n> " + text.format(8)), (8, 0, "user", text.format(8) + "\n> " + text.format(7))]
    got = {r.conv_id: (r.thread_id, r.depth, r.position) for r in C.build_threads(messages(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [(0, i, i) for i in range(5)]
    assert got[7] == (7, 0, 0) and got[8] == (7, 1, 1)


def test_parts_of_a_message_link(spark):
    lines = [f"line number {k} of the long message" for k in range(5)]
    rows = [
        (1, 0, "user", "something else\n" + lines[2]),
        (2, 0, "user", "\n".join(lines)),
        (3, 0, "user", f"> {lines[1]}\n> {lines[2]}\nI quote two lines."),
        (4, 0, "user", "A first paragraph of it.\n\nA second paragraph\nof it.\n\nThe end of all."),
        (5, 0, "user", "> A second paragraph of it.\n>\n> The end of all.\nI quote two paragraphs."),
        (6, 0, "user", "Yes, please"),
        (6, 1, "assistant", "> yes, PLEASE\nGood."),
        (7, 0, "user", "> Yes, please\nNot mine."),
    ]
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in C.build_threads(messages(spark, rows)).collect()}
    assert got[3, 0] == (2, 0) and got[5, 0] == (4, 0) and got[6, 1] == (6, 0) and got[7, 0] == (6, 0)


def test_every_passage_keeps_its_link(spark):
    texts = ["the very first original", "the second one original", "the third one original"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    rows.append((9, 0, "user", f"> {texts[0]}\nyes\n> {texts[1]}\nno\n> > {texts[2]}\nwell"))
    got = {r.conv_id: r for r in C.build_threads(messages(spark, rows)).collect()}
    assert [(x.level, x.to_conv, x.to_turn) for x in got[9].links] == [(1, 0, 0), (1, 1, 0), (2, 2, 0)]
    assert (got[9].parent_conv, got[9].parent_turn) == (0, 0) and got[0].links is None
    assert {r.thread_id for r in got.values()} == {0}


def test_rows_without_conversation_or_turn_stay(spark):
    long = "word " * 60_000 + "end"
    rows = [(None, 0, "user", "the original words"), (None, None, None, "> the original words\nyes"), (1, None, "user", "> the original words"), (1, 5, "user", "the original words")]
    rows += [(2, 0, "user", long), (2, 1, "user", "> " + long + "\nlong indeed")]
    got = C.build_threads(messages(spark, rows)).collect()
    assert len(got) == 6 and sorted(r.position for r in got if r.conv_id is None) == [0, 1]
    assert all(r.parent_conv is None for r in got if r.conv_id is None or r.turn is None)
    assert [r.parent_turn for r in got if (r.conv_id, r.turn) == (2, 1)] == [0]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, real = [], C.save
    monkeypatch.setattr(C, "save", lambda df, tag: rounds.append(tag) or real(df, tag))
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(1001 + i, 1001 + (i + 1) % 40) for i in range(40)], "conv_id long, to_conv long")
    got = {r.conv_id: (r.thread_id, r.depth) for r in C.conversation_depths(edges).collect()}
    assert all(got[i] == (0, i) for i in range(300))
    assert all(got[1001 + i] == (1001, (40 - i) % 40) for i in range(40))
    assert rounds.count("chat-roots") < 25


def brute_links(rows):
    """The message each passage quotes: of all other conversations' messages and all earlier ones of its own, whichever holds most."""
    held = {(c, t): set() for c, t, _, _ in rows}
    for c, t, _, x in rows:
        held[c, t] |= set(C.pieces(C.split_message(x)[0]))
    found = {}
    for c, t, _, x in rows:
        for pos, (level, body) in enumerate(C.split_message(x)[1]):
            asked, ranked = C.pieces(body), []
            for (c2, t2), theirs in held.items():
                common = [p for p in asked if p in theirs]
                if common and (c2 != c or t2 < t):
                    whole, far = any(asked[p] for p in common), c2 != c
                    ranked.append((not whole, 0 if whole else -len(common), far, 0 if far else -t2, c2, t2))
            if ranked:
                found[c, t, pos, level] = min(ranked)[-2:]
    return found


def quoting_messages(seed, conversations=9, turns=4):
    """Trimmed and nested quotes, passages of any length, and two lines that every third message has."""
    import random

    rng = random.Random(seed)
    lines = [f"sentence {k} about {k % 4} things" for k in range(14)] + ["yes", "a", "thank you"]
    often = ["Best regards", "Sent from my phone"]
    rows = []
    for c in range(conversations):
        for t in range(turns):
            parts = []
            for _ in range(rng.randint(0, 3)):
                marks = "> " * rng.randint(1, 3)
                quoted = rng.sample(lines, rng.randint(0, 3)) + rng.sample(often, rng.choice([0, 0, 1, 2]))
                parts += [marks + x for x in quoted] + rng.sample(lines, rng.randint(0, 1))
            rows.append((c, t, "user", "\n".join([*parts, *rng.sample(lines, rng.randint(0, 3)), *rng.sample(often, rng.choice([0, 0, 1, 2]))])))
    return rows


@pytest.mark.parametrize("common", [0, 2, 5, 64])
def test_links_equal_brute_force(spark, common):
    for seed in (3, 4):
        rows = quoting_messages(seed)
        got = C.link(C.parse(messages(spark, rows)), common).collect()
        assert {(r.conv_id, r.turn, r.pos, r.level): (r.to_conv, r.to_turn) for r in got} == brute_links(rows)


def test_the_message_that_holds_both_lines_wins(spark):
    rows = [(1, 0, "user", "A"), (2, 0, "user", "C"), (3, 0, "user", "A\nB\nC"), (4, 0, "user", "> A\n> C\nnew")]
    got = {r.conv_id: r for r in C.build_threads(messages(spark, rows)).collect()}
    assert (got[4].parent_conv, got[4].parent_turn) == (3, 0) and got[4].thread_id == 3


def test_empty_conversations(spark):
    assert C.build_threads(messages(spark, [])).count() == 0
