from limnos.operators import drawing, styles
from limnos.sources import markup

NS = 'xmlns="http://www.w3.org/2000/svg"'


def table(spark, *texts):
    return markup.nodes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, markup string"))


def drawn(spark, *texts):
    return {(r.doc_id, r.shape_index): r for r in drawing.baked(drawing.shapes(table(spark, *texts))).collect()}


def said(spark, *texts):
    return {(r.doc_id, r.kind, r.detail) for r in drawing.warnings(table(spark, *texts)).collect()}


def test_reader_on_odd_markup():
    tags = lambda t: [(n[0], n[1], n[2], n[4]) for n in markup.read(t)]
    assert tags("") == [] and tags("  \n ") == [] and tags("<!-- <a> --><?x?>") == []
    assert tags("<a><b>x</a>y</b>z") == [(0, None, 2, "a"), (1, 0, 2, "b"), (2, 1, 2, "#text"), (3, None, 3, "#text"), (4, None, 4, "#text")]
    assert tags("<p>a<br>b<img/>c") == [(0, None, 5, "p"), (1, 0, 1, "#text"), (2, 0, 2, "br"), (3, 0, 3, "#text"), (4, 0, 4, "img"), (5, 0, 5, "#text")]
    assert [n[8] for n in markup.read("<s><![CDATA[a<b]]></s>&lt;c&gt;")] == [None, "a<b", "<c>"]
    script = markup.read('<script>var t = "</p>" < 3;</script><style>p{}')
    assert [(n[4], n[8]) for n in script] == [("script", 'var t = "</p>" < 3;'), ("style", "p{}")]
    assert markup.attributes(""" a=1 b='x "y' a="2" c xlink:href="#k" d="&amp;" """) == {"a": "1", "b": 'x "y', "c": "", "href": "#k", "d": "&"}
    deep = markup.read("<a>" * 500)
    assert deep[-1][3] == 499 and deep[0][2] == 499


def test_null_and_empty_documents(spark):
    assert table(spark, None, "", " ").count() == 0
    assert drawing.shapes(table(spark, None)).count() == 0 and drawing.warnings(table(spark, "")).count() == 0


def test_rules_and_skipped_selectors(spark):
    css = "<style>/* a{b:c} */ .a, #b , text.c , g rect{FILL: red ; stroke:;x} * {y:z} q{} u:hover{k:v} P-1{a:url(a:b)}</style>"
    got = [(r.selector, r.kind, r.name, r.specificity, [(d["name"], d["value"]) for d in r.declarations]) for r in styles.style_rules(table(spark, css)).orderBy("rule", "part").collect()]
    red = [("fill", "red")]
    assert got == [
        (".a", "class", "a", 2, red), ("#b", "id", "b", 3, red), ("text.c", None, None, None, red), ("g rect", None, None, None, red), ("*", "element", "*", 1, [("y", "z")]),
        ("u:hover", None, None, None, [("k", "v")]), ("P-1", "element", "P-1", 1, [("a", "url(a:b)")]),
    ]


def test_cascade_levels(spark):
    text = (
        '<svg><style>rect{fill:a;opacity:1} .k{fill:b} #i{fill:c} .k{stroke:one} .j{stroke:two}</style><g fill="g" font-size="9">'
        '<rect/><rect class="k j"/><rect class="k" id="i"/><rect fill="f"/><rect class="k" style="fill:s; fill: t"/><circle/></g></svg>'
    )
    got = {}
    for r in styles.cascade(table(spark, text)).collect():
        got.setdefault(r.node, {})[r.name] = (r.value, r.level)
    rects = [got[k] for k in sorted(got) if k > 2]
    assert [r["fill"] for r in rects] == [("a", 1), ("b", 1), ("c", 1), ("f", 2), ("t", 3), ("g", 0)]
    assert rects[1]["stroke"] == ("two", 1) and rects[0]["font-size"] == ("9", 0) and "opacity" not in rects[5]


def test_unsafe_attributes_and_scripts(spark):
    text = (
        f'<svg {NS} viewBox="0 0 100 100"><rect x="0" y="0" width="100" height="100" fill="#ffffff" onload="a(b)" onclick="f()"/><image href="javascript:a(1)"/>'
        '<image href="data:image/png;base64,AAAA"/><image href="../a.png"/><script>a(1)</script></svg>'
    )
    got = drawn(spark, text)
    assert [got[0, k].attrs.get("href") for k in range(4)] == [None, None, "data:image/png;base64,AAAA", "../a.png"]
    assert set(got[0, 0].attrs) == {"x", "y", "width", "height", "fill"}
    assert said(spark, text) == {(0, "script", "script"), (0, "unsafe attribute", "onload"), (0, "unsafe attribute", "onclick"), (0, "unsafe attribute", "href")}


def test_sheet_reaches_shapes(spark):
    got = drawn(spark, f'<svg {NS}><style>.brand{{fill:#ff0000}} .hd{{font-family:Papyrus;font-size:19px}}</style><circle class="brand" cx="50" cy="50" r="12"/><text class="hd" x="10" y="150">Head <tspan>line</tspan>\n two</text></svg>')
    assert got[0, 0].attrs["fill"] == "#ff0000" and got[0, 1].attrs["font-family"] == "Papyrus" and got[0, 1].text == "Head line two"


def test_uses(spark):
    one = '<svg><defs><rect id="p" width="20" height="20" fill="#1a56db"/><g id="q" fill="no"><circle r="1"/><use href="#p" x="1"/></g></defs><g fill="red"><use xlink:href="#p" x="100" y="100"/><use href="#q" y="3"/></g><use href="#gone"/><use href="a.svg"/></svg>'
    got = drawn(spark, one)
    assert [(got[0, k].tag, got[0, k].attrs.get("fill"), got[0, k].attrs.get("x"), got[0, k].attrs.get("y"), got[0, k].attrs.get("cy")) for k in range(3)] == [
        ("rect", "#1a56db", "100", "100", None), ("circle", "red", None, None, "3"), ("rect", "#1a56db", "1", "3", None),
    ]
    assert said(spark, one) == {(0, "use of missing id", "#gone"), (0, "use without reference", "use")}
    loop = '<svg><g id="l"><rect width="1" height="1"/><use href="#l" x="1"/></g></svg>'
    got = drawn(spark, loop)
    assert len(got) == 1 + drawing.MAX_USES and {r.attrs.get("x") for r in got.values()} == {None, *map(str, range(1, drawing.MAX_USES + 1))}
    assert said(spark, loop) == {(0, "use too deep", "use")}


TRANSFORMS = [
    ('<g transform="translate(10 10)"><rect x="0" y="0" width="10" height="10" stroke-width="1" transform="scale(2)"/></g>', {"x": "10", "y": "10", "width": "20", "height": "20", "stroke-width": "2"}, True),
    ('<rect x="5" y="5" width="30" height="10" transform="rotate(30)"/>', {"width": "30", "x": "5"}, False),
    ('<circle cx="1" cy="2" r="3" transform="scale(2 3)"/>', {"r": "3"}, False), ('<ellipse cx="1" cy="2" rx="3" ry="4" transform="scale(2 3)"/>', {"cx": "2", "cy": "6", "rx": "6", "ry": "12"}, True),
    ('<line x1="1" x2="2" y2="1" transform="rotate(90)"/>', {"x1": "0", "y1": "1", "x2": "-1", "y2": "2"}, True), ('<polygon points="0,0 1,0 1,1" transform="matrix(0 1 -1 0 5 0)"/>', {"points": "5,0 5,1 4,1"}, True),
    ('<text x="1" y="2" font-size="10" transform="translate(10-5)">t</text>', {"x": "11", "y": "-3", "font-size": "10"}, True), ('<rect x="1" width="2" height="2" transform="spin(3)"/>', {"x": "1"}, None),
]


def test_transforms(spark):
    got = drawn(spark, *[f"<svg>{inner}</svg>" for inner, _, _ in TRANSFORMS])
    for k, (_, want, baked) in enumerate(TRANSFORMS):
        r = got[k, 0]
        assert {n: r.attrs[n] for n in want} == want and r.baked is baked
        assert (r.matrix is None) == (baked is not False)


def test_defs_dielines_and_gradients(spark):
    text = (
        '<svg><defs><clipPath id="c"><rect/></clipPath><foo/><linearGradient id="a" x1="3px"><stop offset="50%"/><stop offset="1" style="stop-color:blue"/></linearGradient></defs>'
        '<g id="dieline"><rect fill="url(#a)"/></g><rect class="x dieline"/><rect stroke="url( #b )"/><radialGradient cx="1"/><title>t</title><foreignObject/><bar/></svg>'
    )
    nodes = table(spark, text)
    assert [r.dieline for r in drawing.shapes(nodes).orderBy("shape_index").collect()] == [True, True, False]
    grads = drawing.gradients(nodes).orderBy("node").collect()
    assert [(g.id, g.kind, g.coords, [tuple(s) for s in g.stops or []]) for g in grads] == [("a", "linear", {"x1": 3.0}, [(0.5, "#000000"), (1.0, "blue")]), ("grad1", "radial", {"cx": 1.0}, [])]
    assert [(r.shape_index, r.property, r.id) for r in drawing.paints(drawing.shapes(nodes), drawing.gradients(nodes)).collect()] == [(0, "fill", "a")]
    assert said(spark, text) == {(0, "kept", "clipPath"), (0, "dropped", "foo"), (0, "foreign", "foreignObject"), (0, "unknown", "bar")}
    assert [(r.width, r.height) for r in drawing.canvas(table(spark, '<svg viewBox="0,0 5 6"/>', '<svg width="7px"/>')).orderBy("doc_id").collect()] == [(5.0, 6.0), (7.0, 100.0)]


def test_written_shapes_read_the_same(spark):
    text = '<svg><g transform="rotate(30)"><rect x="1" width="2" height="3" fill="a&amp;&quot;b"/></g><text x="1" y="2">a &lt; b</text></svg>'
    first = drawn(spark, text)
    parts = [r.markup for r in drawing.written_shapes(drawing.baked(drawing.shapes(table(spark, text)))).orderBy("shape_index").collect()]
    again = drawn(spark, "<svg>" + "".join(parts) + "</svg>")
    assert [(r.tag, r.attrs, r.text) for r in again.values()] == [(r.tag, r.attrs, r.text) for r in first.values()]
    assert all(abs(a - b) < 1e-5 for a, b in zip(first[0, 0].matrix, again[0, 0].matrix, strict=True))
