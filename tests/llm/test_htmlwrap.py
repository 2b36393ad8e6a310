"""Wrappers: alignment, independence of order, extraction that names cannot do, and hostile markup."""

import random
import re
import time

from pyspark.sql import functions as F

from quire.llm import htmlwrap as H

PAGE = "page_id long, url string, html string, host string, text string, rule int"


def learned(pages):
    got = None
    for p in pages:
        one = H.page_wrapper(H.parse(p))
        got = one if got is None else H.align(got, one)
    return got


def test_alignment_finds_optional_repeated_and_variable_items():
    w = learned(["<div><h1>A</h1><p>x</p></div>", "<div><h1>B</h1><p>y</p><p>z</p><hr><table><tr><td>q</table></div>"])
    div = w.columns["div"][2][0]
    assert {label: (k < div.n, repeats) for label, (k, repeats, _) in div.columns.items()} == {"h1~": (False, False), "p~": (False, True), "table": (True, False)}
    heading = div.columns["h1~"][2][0].columns["#"][2][0]
    assert heading.low != heading.high  # its text varies
    assert H.expression(w) == r"(?:<div>(?:<h1\~>(?:#)</>)(?:<p\~>(?:#)</>)+(?:<table>(?:<tr\~>(?:#)</>)</>)?</>)"
    rows = learned(["<dl>" + "<dt>a</dt><dd>b</dd>" * 4 + "</dl>", "<dl>" + "<dt>a</dt><dd>b</dd>" * 2 + "</dl>"])
    assert H.expression(rows) == r"(?:<dl>(?:(?:<dd\~>(?:#)</>)*(?:<dt\~>(?:#)</>)*)+</>)"
    same = learned(["<div>one</div><div>two</div>", "<div>three</div><div>two</div>"])
    assert [s.low == s.high for e in same.columns["div~"][2] for s in e.columns["#"][2]] == [False, True]  # equal numbers pair by ordinal


def random_page(rng, depth=3):
    def some(d):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(["div", "p", "ul", "section", 'div class="x"', "article"])
            out += f"<{tag}>" + (some(d - 1) if d and tag != "p" and rng.random() < 0.7 else rng.choice(["same", str(rng.randrange(4))])) + f"</{tag.split()[0]}>"
        return out

    return some(depth)


def test_every_page_matches_its_expression_and_order_does_not_matter():
    rng = random.Random(7)
    for _ in range(60):
        pages = [random_page(rng) for _ in range(rng.randrange(1, 7))]
        w = learned(pages)
        text, form = H.dump(w), re.compile(H.expression(w))
        assert all(form.fullmatch(H.tokens(H.parse(p))) for p in pages)
        assert "|" not in H.expression(w)
        assert H.dump(H.load(text)) == text
        for _ in range(3):
            rng.shuffle(pages)
            cut = rng.randrange(len(pages) + 1)
            halves = [x for x in (pages[:cut], pages[cut:]) if x]
            got = learned(halves[0])
            if len(halves) > 1:
                got = H.align(got, H.load(H.dump(learned(halves[1]))))
            assert H.dump(got) == text


def nameless(k, rng, paragraphs):
    """A page of plain <div>s: a varying bar of links, a constant notice, the story, a varying teaser, a constant foot."""
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(n))
    story = [f"Title {k} {say(3)}", *(say(rng.randrange(12, 30)) for _ in range(paragraphs))]
    bar = "".join(f'<div><a href="/{say(1)}">{say(2)}</a></div>' for _ in range(rng.randrange(2, 5)))
    html = (
        f"<html><body><div><div>{bar}</div></div><div>We use small files to remember you</div><div><div><h1>{story[0]}</h1>" + "".join(f"<p>{x}</p>" for x in story[1:])
        + f"<div>Follow this site now</div></div></div><div><div>Buy {say(2)}</div></div><div>All rights kept by the house</div></body></html>"
    )
    return html, story


def brute_text(pages):
    """Blocks that are not on every page, of the top-level <div> with most text outside links over all pages."""
    blocks = lambda html: [re.sub("<.*?>", " ", x).split() for x in re.split(r"(?:</?(?:div|p|h1|body|html)>)+", html)]
    common = set.intersection(*({tuple(b) for b in blocks(p)} for p in pages))
    tops = [re.split(r"<cut>", re.sub(r"(?<=</div>)(?=<div>)", "", split_top(p))) for p in pages]
    weight = [sum(len(re.sub("<.*?>", "", re.sub("<a .*?</a>", "", t[i]))) for t in tops) for i in range(len(tops[0]))]
    weight = [0 if len({t[i] for t in tops}) == 1 else w for i, w in enumerate(weight)]
    best = weight.index(max(weight))
    return ["\n".join(" ".join(b) for b in blocks(t[best]) if b and tuple(b) not in common) for t in tops]


def split_top(html):
    out, depth = "", 0
    for part in re.split(r"(</?div>)", html[len("<html><body>") : -len("</body></html>")]):
        depth += {"<div>": 1, "</div>": -1}.get(part, 0)
        out += part + ("<cut>" if part == "</div>" and depth == 0 else "")
    return out.removesuffix("<cut>")


def test_alignment_alone_finds_the_text(spark):
    """No article, nav or telling class: only alignment tells the story from what stands around it."""
    rng = random.Random(3)
    made = [nameless(k, rng, rng.randrange(1, 6)) for k in range(12)]
    want = {k: "\n".join(story) for k, (_, story) in enumerate(made)}
    assert brute_text([h for h, _ in made]) == list(want.values())
    rows = [(k, f"http://h.net/{k}", h, "h", "t", 1) for k, (h, _) in enumerate(made)]
    df = spark.createDataFrame(rows, PAGE)
    for parts in (1, 5):
        assert {r.page_id: r.text for r in H.extract(df.repartition(parts)).collect()} == want
    alone = {k: H.main_text(h, None) for k, (h, _) in enumerate(made)}
    assert all(alone[k] != want[k] for k in want)


def test_pages_of_another_make_keep_their_text():
    """Most pages of a host have their text in one place; the few that have it elsewhere lose nothing."""
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    usual = [f'<body><div class="a"><h1>{say(3)}</h1><p>{say(90)}</p></div><div class="b"><div>{say(2)}</div></div></body>' for _ in range(40)]
    other = f'<body><div class="b"><div>{say(60)}</div><p>{say(30)}</p></div></body>'
    w = H.decide(learned([*usual, other]))
    assert H.main_text(other, w) == H.main_text(other, None)
    assert all(len(H.main_text(p, w).split()) == 93 for p in usual)


def test_wrapper_is_the_same_over_any_partitions(spark):
    rng = random.Random(5)
    rows = [(f"h{k % 3}.net", random_page(rng)) for k in range(60)]
    df = spark.createDataFrame(rows, "host string, html string")
    first = sorted(map(tuple, H.wrappers(df.coalesce(1)).collect()))
    assert first == sorted(map(tuple, H.wrappers(df.repartition(7, F.rand(1))).collect())) and len(first) == 3
    assert H.dump(learned([h for k, (_, h) in enumerate(rows) if k % 3 == 0])) == first[0][1]


def test_hostile_markup_takes_seconds():
    for html in ("<div>" * 100_000 + "deep", "<div>" * 50_000 + "deep" + "</p>" * 50_000 + "</div>" * 50_000, '<a x="y ' * 130_000, "<a x=\"y ' " * 90_000 + ">", "<!" * 400_000, "<script>" + "</script " * 90_000, "</div>" * 200_000):
        began = time.perf_counter()
        w = learned([html, html])
        text = H.main_text(html, H.decide(H.load(H.dump(w))))
        assert time.perf_counter() - began < 30
        assert not html.endswith("deep") or text == "deep"


def test_quotes_and_tags_of_broken_pages():
    assert H.main_text('<p title="a > b">one<p class="open>two</p><p>three', None) == "one\ntwo\nthree"
    assert H.main_text("<p>a < b<p>x<<b>y</b>", None) == "a < b\nx<y"
    assert H.main_text("<p>a<!-- no end <p>b", None) == "a" and H.main_text("<p>a</div></section>b", None) == "a\nb"
