import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import html_extract as hx


def text(html):
    return hx.content(hx.tree(html), None)[0]


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("", ""), ("plain  text\n", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div><p>un<b>closed", "unclosed"), ("a < b &lt;c&gt; &eacute;", "a < b <c> é"), ("<script>if(a<b){'</p>'}</script>ok", "ok"), ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<article><header><h1>T</h1></header><p>x<!-- <p>no</p> --> <i>y</i><br>z</p></article>after", "T\n\nx y z"), ("<body><header>Site</header><nav>menu</nav><main><p>A</p><div class='user-comments'><p>c</p></div></main><aside>s</aside><form>f</form><footer>x</footer>", "A"),
        ("<article><p>keep <span class='ad'>buy</span>this</p><div role='complementary'>no</div><p hidden>no</p><div style='display: none'>no</div></article>", "keep this"), ("<div class='cookie-notice'>no</div><div id='sidebar'>no</div><p>yes</p>", "yes"), ("<article><p>a</p></article><article class='comment'><p>b</p></article>", "a"), ("<!-- open <p>x", ""),
        ("<article><div class='search'>How search works</div><p>sum <math><mi>x</mi></math> and</p><div class='related toolbar'>kept</div><div class='newsletter'>no</div></article>", "How search works\n\nsum x and\n\nkept"), ("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after", "deep\n\nafter"),
        ("<div class='ad-free'><article><div class='entry-header'><h1>T</h1></div><p>b</p><div class='ad'>x</div></article><p>y</p></div>", "T\n\nb"), ("<div id='comments'><article class='comment'><p>c</p></article></div><div class='nav-wrap'><main><p>m</p></main></div>", "m"),
    ],
)
def test_pages(html, wanted):
    assert text(html) == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<b", ">", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "&#x;", "<li>", "</ul>", "'", '"', "<td>", "<br/>", "\n"]), max_size=40).map("".join))
def test_any_markup_is_read(html):
    assert "\n\n\n" not in text(html)


def brute(a, b):
    """Simple tree matching by its definition."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            own = 1 + brute(x[1], y[1]) if x[0] == y[0] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + own)
    return best[-1][-1]


def test_matching_equals_its_definition():
    rng = random.Random(6)

    def grown(depth):
        return [[rng.choice("abc"), grown(depth - 1) if depth else [], []] for _ in range(rng.randint(0, 4))]

    for _ in range(200):
        a, b = grown(2), grown(2)
        if [x[0] for x in a] != [x[0] for x in b]:
            score, pairs = hx.matching(a, b)
            assert score == brute(a, b)
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
            assert sum(1 + hx.matching(a[i][1], b[j][1])[0] for i, j in pairs) == score


def page(k, extra=""):
    return f"<html><body><div>Our shop since 1990</div><article><h1>t{k}</h1>{''.join(f'<p>body {k} {i}</p>' for i in range(k % 4 + 1))}{extra}<p>Subscribe now</p></article></body></html>"


def test_template_of_a_host_is_left_out(spark):
    rows = [(k, f"https://Shop.example.com/{k}", page(k)) for k in range(60)] + [(100 + k, f"http://few.example.org/{k}", page(k)) for k in range(5)] + [(200 + k, "http://copies.example.org/", page(7)) for k in range(40)]
    rows += [(300, None, page(1)), (301, "http://[bad", page(1)), (302, "http://shop.example.com/none", None), (0, "https://Shop.example.com:8080/0", page(0)), (400, "http://one.example.org/", page(1)), (401, "http://three.example.org/", page(1)), (402, "http://three.example.org/", page(2)), (403, "http://three.example.org/", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"__hx_host": F.lit("x"), "__hx_text": F.lit(1)}).repartition(6)
    found = {r.page_id: r["__hx_text"] for r in hx.extract(df).collect()}
    assert len(found) == len(rows) - 1
    for k in [*range(60), *range(100, 105)]:
        assert found[k] == "\n\n".join([f"t{k % 100}", *(f"body {k % 100} {i}" for i in range(k % 100 % 4 + 1))])
    for k in (204, 300, 301, 400, 401):  # copies, no host, one page, too few pages to be sure
        assert found[k].endswith("Subscribe now") and found[k].startswith("t")
    assert found[302] == ""
    assert hx.extract(df.limit(0)).count() == 0


def test_constant_texts_of_bodies_without_an_article(spark):
    rows = [(k, "http://h.example.com/", f"<body><div>Imprint</div><div><p>own {k}</p><p>more {k * k}</p><p>and {k}!</p></div></body>") for k in range(50)]
    found = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r["__hx_text"] for r in found}[3] == "own 3\n\nmore 9\n\nand 3!"


def nameless(rng, k):
    """A page whose tags and names say nothing: a varying menu, a varying advert, the text, a varying foot; now and then another element between them."""
    word = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    body = [word(3), *(word(rng.randint(12, 40)) for _ in range(rng.randint(2, 6)))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body[1:])
    odd = f"<section class=x9>{word(2)}</section>" if k % 7 == 0 else ""
    links = "".join(f"<li><a href=/>{word(1)}</a></li>" for _ in range(4))
    html = f"<body><div class='a{k}'><ul>{links}</ul></div>{odd}<div class=b>{word(5)}</div><div class='c post-{k}'><h2>{body[0]}</h2>{paragraphs}</div><div class=d>{word(4)}</div></body>"
    return html, "\n\n".join(body)


def test_the_place_decides_where_names_say_nothing(spark):
    rng = random.Random(11)
    made = [nameless(rng, k) for k in range(120)]
    df = spark.createDataFrame([(k, "https://plain.example.net/", html) for k, (html, _) in enumerate(made)], "page_id long, url string, html string").repartition(5)
    found = hx.extract(df).collect()
    assert [r["__hx_text"] for r in sorted(found, key=lambda r: r.page_id)] == [text for _, text in made]
    assert all(r["__hx_placed"] >= 6 for r in found)


def one_task(pages):
    """Texts by plain counts over all pages of each host at once."""
    hosts = {}
    for k, host, html in pages:
        hosts.setdefault(host, []).append((k, html))
    out = {}
    for own in hosts.values():
        first = sorted({hx.number(h): h for _, h in own}.items())[: hx.REFERENCE]
        wrapper = None
        for _, html in first:
            bare = hx.bare(hx.folded(hx.tree(html)))
            wrapper = bare if wrapper is None else hx.merged(wrapper, bare)
        plan = None
        if len(first) > 1:
            wrapper = hx.numbered(wrapper)
            sums = {}
            for _, html in own:
                for key, value in hx.counted(html, wrapper).items():
                    sums[key] = [a + b for a, b in zip(sums.get(key, [0, 0, 0]), value, strict=True)]
            slots = {s: tuple(v) for (s, t), v in sums.items() if t is None}
            common = {}
            for (s, t), (n, chars, _) in sums.items():
                if t is not None:
                    total = slots[s][0]
                    share, z = n / total, 1.96**2
                    low = (share + z / 2 / total - math.sqrt(z * (share * (1 - share) / total + z / 4 / total**2))) / (1 + z / total)
                    if n >= hx.SURE and share >= hx.SHARE and low >= 0.5:
                        common[s, t] = (n, chars)
            plan = hx.Plan(wrapper, slots, common)
        for k, html in own:
            out[k] = hx.content(hx.tree(html), plan)[0]
    return out


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_partitions_do_not_matter(spark, parts):
    rng = random.Random(2)
    pages = [(k, f"h{k % 3}.example.com", nameless(rng, k)[0]) for k in range(90)]
    pages += [(1000 + k, "mixed.example.com", page(k, f"<p>{'Notice' if k % 10 else 'Other'}</p>" if k % 12 else "")) for k in range(100)]
    pages += [(2000 + k, "mixed.example.com", nameless(rng, k)[0]) for k in range(20)]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", html) for k, h, html in pages], "page_id long, url string, html string").orderBy(F.rand(parts)).repartition(parts)
    assert {r.page_id: r["__hx_text"] for r in hx.extract(df).collect()} == one_task(pages)


def test_query_over_a_whole_table(spark):
    """Every page's article, less what the host repeats; the wrapper decides a share of the blocks."""
    rows = hx.op7_html_extract(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and r.text == text(pages[r.page_id])


def test_wrappers_stay_small():
    """Pages whose classes differ by numbers share their nodes."""
    trees = [hx.bare(hx.folded(hx.tree(f"<body><div class='post-{k}'><p>x</p></div><div class='id{k} b'>y</div></body>"))) for k in range(50)]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = hx.merged(wrapper, t)
    assert hx.bare(wrapper) == trees[0]
