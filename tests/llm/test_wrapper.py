import random
from collections import Counter
from functools import cache

from palimpsest.llm import wrapper

PAGES = "page_id long, url string, html string, host string, gone int"


def naive(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + naive(x, y))
    return 1 + m[-1][-1]


def test_scores_are_those_of_the_definition():
    rng = random.Random(8)

    def tree(depth):
        return (rng.randrange(2), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    shapes = wrapper.Shapes()
    number = lambda t: shapes.of(t[0], tuple(number(k) for k in t[1]))
    for _ in range(200):
        a, b = tree(4), tree(4)
        assert shapes.score(number(a), number(b)) == naive(a, b)


def test_alignments_have_the_best_score():
    rng = random.Random(9)
    shapes = wrapper.Shapes()
    leaves = [shapes.of(k, ()) for k in range(4)]
    for _ in range(200):
        x, y = (tuple(rng.choice(leaves) for _ in range(rng.randrange(9))) for _ in range(2))
        pairs = shapes.aligned(x, y)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        best = int(shapes.rows(x, y)[-1][-1]) if x and y else 0
        assert sum(shapes.score(x[i], y[j]) for i, j in pairs) == best


def page(k, paragraphs):
    return f"<html><head><title>T{k}</title></head><body><nav><ul><li>Home</li><li>About us</li></ul></nav><div class=m><h1>Title {k}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><footer>Imprint and contact</footer></body></html>"


def test_template_goes_and_content_stays(spark):
    rows = [(k, f"https://Site.example/p/{k}", page(k, [f"text {k} {j}" for j in range(k % 4 + 1)]), "x", 1) for k in range(8)]
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k, r in got.items():
        assert r["host"] == "site.example"
        assert r["content"].split("\n") == [f"T{k}", f"Title {k}", *(f"text {k} {j}" for j in range(k % 4 + 1))]
        assert r["template_leaves"] == 3


def nested(html):
    """(label, kids, leaf number, region) of a page, from its nodes in document order."""
    _, nodes = wrapper.leaves_and_tree(html)
    marks, path, root = wrapper.regions(nodes), [], None
    for (depth, label, leaf), region in zip(nodes, marks):
        node = (label, [], leaf, region)
        while path and path[-1][0] >= depth:
            path.pop()
        if path:
            path[-1][1][1].append(node)
        path.append((depth, node))
        root = root or node
    return root


def shape(t):
    return (t[0], tuple(shape(k) for k in t[1]))


@cache
def matched(a, b):
    """Simple tree matching of two shapes by its definition."""
    if a[0] != b[0]:
        return 0
    return 1 + table(a[1], b[1])[-1][-1]


@cache
def table(x, y):
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(a, b))
    return m


def leaves_of(t):
    return ([t[2]] if t[2] >= 0 else []) + [x for k in t[1] for x in leaves_of(k)]


def alignment(x, y):
    """Of the best alignments of two lists of shapes the one that pairs equal beginnings and ends, then leaves out of x before y from the end."""
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)] + [(len(x) - 1 - k, len(y) - 1 - k) for k in range(hi)]
    p, q = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if len(p) == 1 and q:
        best = max(range(len(q)), key=lambda j: (matched(p[0], q[j]), -j))
        return out + [(lo, lo + best)] * (matched(p[0], q[best]) > 0)
    m, i, j = table(p, q), len(p), len(q)
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((lo + i, lo + j))
    return out


def places(page, seed, texts, seed_texts, out, at=()):
    """Leaves of a page with what of the seed they tell of: a leaf of equal text, or a region by its place."""
    if page[2] >= 0:
        if seed[2] >= 0 and texts[page[2]] == seed_texts[seed[2]]:
            out.append((page[2], seed[2]))
        return out
    if page[3] and seed[3]:
        out += [(k, ("region", at)) for k in leaves_of(page)]
    for i, j in alignment(tuple(map(shape, page[1])), tuple(map(shape, seed[1]))):
        places(page[1][i], seed[1][j], texts, seed_texts, out, (*at, j))
    return out


def brute(rows):
    """{page: leaf numbers that are template} for pages of one layout a host; nothing but the parser is the module's."""
    hosts, out = {}, {}
    for i, u, h in sorted(rows):
        hosts.setdefault(u.split("//")[1].split("/")[0].lower(), []).append((i, h))
    for pages in hosts.values():
        texts = {i: [t for t, _ in wrapper.leaves_and_tree(h)[0]] for i, h in pages}
        seed = pages[0][0]
        trees = {i: nested(h) for i, h in pages}
        told = {i: places(trees[i], trees[seed], texts[i], texts[seed], []) for i in trees}
        votes = Counter(b for i, x in told.items() if i != seed for b in {b for _, b in x})
        fixed = {b for b, n in votes.items() if n >= wrapper.CONSTANT * (len(trees) - 1)} if len(trees) > 1 else set()
        out |= {i: (texts[i], {a for a, b in told[i] if b in fixed}) for i in trees}
    return out


def test_as_brute_force_over_the_table(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r["html"]]
    rng = random.Random(12)
    for k in range(24):
        body = "".join(rng.choice(["<p>same words</p>", f"<p>own {k} {rng.random()}</p>", "<ul><li>a<li>b</ul>", "<div class=ad>buy</div>", f"<div class=x><b>{k}</b> part</div>"]) for _ in range(rng.randrange(7)))
        rows.append((90_000 + k, f"http://made{k % 2}.example/{k}", f"<html><head><title>t</title></head><body><nav><a>one</a><a>two {k}</a></nav>{body}<footer>end {k % 3}</footer></body></html>"))
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, host string, gone int")).collect()}
    removed = 0
    for i, (texts, gone) in brute(rows).items():
        assert (got[i]["leaves"], got[i]["template_leaves"]) == (len(texts), len(gone)), i
        assert got[i]["content"].split() == " ".join(t for k, t in enumerate(texts) if k not in gone).split()
        removed += len(gone)
    assert removed > 100


def test_deep_pages_are_aligned_whole(spark):
    """3,000 levels: the labels and texts at the bottom count like all others."""
    deep = lambda k: "<div>" * 3000 + f"<p>same at the bottom</p><p>own {k}</p>" + "</div>" * 3000 + f"<p>top {k}</p>"
    rows = [(k, f"http://deep.example/{k}", deep(k), None, None) for k in range(4)]
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k]["content"].split("\n") == [f"own {k}", f"top {k}"] and got[k]["template_leaves"] == 1 for k in range(4))
    _, depths, _, text = wrapper.unpacked(wrapper.packed(deep(1)))
    assert depths.max() == 3002 and (text > 0).sum() == 3


def test_labels_and_texts_do_not_collide():
    html = "".join(f"<div id=post-{k}>text {k}</div>" for k in range(5000))
    labels, _, _, text = wrapper.unpacked(wrapper.packed(html))
    assert len(set(labels.tolist())) == 5002 and len(set(text.tolist())) == 5001


def test_edges(spark):
    same = (1, "http://a.example/x", page(1, ["p"]), None, None)
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [same, same, (2, "http://a.example/y", page(2, ["q"]), "h", 1), (3, None, "<p>no url</p>", "h", 1), (4, "http://b.example", None, "h", 1), (5, "http://b.example", "", "h", 1), (None, "http://c.example", "<p>one<p>two", "h", 1), (6, "nonsense", deep, "h", 1), (7, "//d.example:80/x", "<p>" + "long " * 100_000, "h", 1), (None, None, None, None, None), (8, "http://e.example", "a < b <c & &amp; </x> <", "h", 1)]
    got = wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["host"] == "" and by[3]["content"] == "no url" and by[4]["content"] == "" and by[5]["content"] == ""
    assert by[6]["content"] == "deep" and by[7]["host"] == "d.example" and len(by[7]["content"]) == 499_999
    assert by[2]["content"].split("\n") == ["T2", "Title 2", "q"]
    assert sum(r["page_id"] == 1 for r in got) == 2
    assert wrapper.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_aligned_regions_go_though_their_texts_vary(spark):
    html = "<html><body><nav><ul><li><a>link {0}</a><li><a>more {0}</a></ul></nav><div class='ad big'>buy {0}</div><article><h1>Title {0}</h1><p>text {0}</p><footer>by author {0}</footer></article><footer>&copy; site &middot; {0}</footer></body></html>"
    rows = [(k, f"http://r.example/{k}", html.format(f"w{k}"), None, None) for k in range(6)] + [(9, "http://alone.example/", html.format("w9"), None, None)]
    for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect():
        k = r["page_id"]
        if k < 9:
            assert r["content"].split("\n") == [f"Title w{k}", f"text w{k}", f"by author w{k}"] and r["template_leaves"] == 4
        else:
            assert r["template_leaves"] == 0


def test_a_region_counts_once_a_page(spark):
    nav = "<nav>" + "".join(f"<a>link {k}</a>" for k in range(9)) + "</nav>"
    rows = [(k, f"http://r.example/{k}", f"<body>{nav if k < 2 else ''}<p>text {k}</p></body>", None, None) for k in range(8)]
    assert all(r["template_leaves"] == 0 for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect())


def test_each_layout_of_a_host_has_its_own_template(spark):
    kinds = [
        "<html><body><section class=top><h2>Shop of things</h2></section><div class=a><p>item {0}</p></div></body></html>",
        "<html><body><table class=list><tr><td>Forum of things</td></tr><tr><td>post {0}</td></tr></table><form><label>Reply</label></form></body></html>",
        "<html><body><dl class=wiki><dt>All about things</dt><dd>entry {0}</dd></dl><pre>licence of the wiki</pre><ol><li>one rule</li></ol></body></html>",
    ]
    odd = "<html><body><h1>odd</h1><blockquote>page</blockquote></body></html>"
    rows = [(0, "http://m.example/0", odd, None, None)] + [(k, f"http://m.example/{k}", kinds[k % 3].format(f"w{k}"), None, None) for k in range(1, 13)]
    got = {r["page_id"]: (r["content"], r["template_leaves"]) for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == ("odd\npage", 0)
    for k in range(1, 13):
        assert got[k] == (f"{('item', 'post', 'entry')[k % 3]} w{k}", (1, 2, 3)[k % 3])
