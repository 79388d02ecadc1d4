import pytest

from vellumtide.errors import PdfFault
from vellumtide.operators import editing as E
from vellumtide.operators import layout, tables
from vellumtide.sources import raster
from vellumtide.sources.inspect import Outline
from vellumtide.sources.pdfobjects import Aes, Pdf, inflate, rc4
from vellumtide.sources.pdfpage import Page, jpeg_header, png, unpng
from vellumtide.sources.pdfwriter import Draft, number, text_document
from vellumtide.sources.readers import page_rows


def three() -> bytes:
    return text_document([[(40, 20, 20, "Page one (x)")], [(40, 20, 10, "Page two")], [(40, 20, 10, "Page three")]], title="T")


def texts(data, password=None):
    return ["".join(r["glyphs"]["text"]) for r in page_rows("d", data, password)]


def raw(bodies: dict[int, bytes]) -> bytes:
    out, where = bytearray(b"%PDF-1.7\n"), {}
    for n, b in bodies.items():
        where[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % where[n] for n in bodies)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(bodies) + 1, start))


def content_page(content: bytes, size=(340, 300), rotate=0) -> bytes:
    return raw({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 %d %d]/Rotate %d/Resources<</Font<</F1 5 0 R>>>>>>" % (*size, rotate), 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 4: b"<</Length %d>>stream\n" % len(content) + content + b"\nendstream", 5: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"})


def test_ciphers_by_published_vectors():
    assert Aes(bytes(range(16))).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert Aes(bytes(range(32))).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("how", [{}, {"deflate": True, "object_streams": True}, {"garbage": False}])
def test_save_and_reopen(how):
    d = Draft(three())
    E.select(d, [2, 0, 0])
    E.set_metadata(d, {"title": "Zoë", "author": "A"})
    E.set_labels(d, [{"startpage": 0, "style": "r"}, {"startpage": 2, "style": "D", "prefix": "A-", "firstpagenum": 5}])
    E.set_toc(d, [[1, "one", 1], [2, "two", 3]])
    E.set_attachments(d, [{"name": "b", "data": b"B"}, {"name": "a", "data": b"A"}])
    data = d.save(**how)
    assert texts(data) == ["Page three", "Page one (x)", "Page one (x)"]
    o = Outline(Pdf(data))
    assert o.toc() == [[1, "one", 1], [2, "two", 3]]
    assert [r["firstpagenum"] for r in o.labels()] == [1, 5]
    assert [(a["name"], a["data"]) for a in o.attachments()] == [("a", b"A"), ("b", b"B")]


def test_encryption_codes():
    data = Draft(three()).save(user_pw="u", owner_pw="o")
    assert [Pdf(data).authenticate(p) for p in ("x", "u", "o")] == [0, 2, 4]
    assert texts(data, "u")[1] == "Page two"
    assert page_rows("d", data)[0]["error"].startswith("PasswordRefused")
    both = Draft(three()).save(user_pw="same")
    assert Pdf(both).authenticate("same") == 6 and Pdf(three()).authenticate("") == 1
    open_ = Draft(three()).save(user_pw="")
    assert not Pdf(open_).needs_pass and texts(open_)[0] == "Page one (x)"


def test_damaged_cross_references_are_rebuilt():
    data = three()
    at = data.rfind(b"startxref")
    assert texts(data[:at] + b"startxref\n7\n%%EOF")[2] == "Page three"
    with pytest.raises(PdfFault):
        Pdf(b"nothing")


def test_decompression_guard():
    import zlib

    with pytest.raises(PdfFault):
        inflate(zlib.compress(b" " * 200_000), 1000)
    assert len(inflate(zlib.compress(b" " * 1000), 1000)) == 1000


def test_insert_ranges():
    a, b = Draft(three()), Draft(text_document([[(40, 20, 10, c)] for c in "abcd"]))
    E.insert(a, b, 2, 1, 1)
    assert texts(a.save()) == ["Page one (x)", "c", "b", "Page two", "Page three"]
    with pytest.raises(ValueError):
        E.insert(a, a)
    with pytest.raises(IndexError):
        E.delete(a, [9])
    E.delete(a, [-1, 0])
    assert texts(a.save())[0] == "c"


def test_toc_and_metadata_are_checked_first():
    d = Draft(three())
    for bad in ([[2, "x", 1]], [[1, "x", 1], [3, "y", 1]], [[1, "x", 9]]):
        with pytest.raises(ValueError):
            E.set_toc(d, bad)
    with pytest.raises(TypeError):
        E.set_metadata(d, {"title": "new", "author": 3})
    assert d.info["Title"] == b"T"


def test_drawing_round_trip():
    d = Draft(three())
    assert E.insert_text(d, 0, (72, 100), "a\r\nb") == 2
    assert E.replace_text(d, 0, "one", "1") == 1
    E.insert_image(d, 1, (0, 0, 100, 50), png(2, 2, bytes([255, 0, 0] * 4), 3))
    E.add_ocr_layer(d, 2, [(10, 10, 60, 20, "日本"), (70, 10, 100, 20, "abc")])
    E.show_page(d, 2, (100, 100, 300, 300), Draft(text_document([[(40, 20, 20, "in")]])))
    E.add_highlight(d, 0, [(10, 10, 50, 30)])
    E.add_link(d, 0, (10, 10, 50, 30), "http://x.y")
    rows = page_rows("d", d.save())
    assert ["".join(r["glyphs"]["text"]) for r in rows] == ["Page 1 (x)ab", "Page two", "Page three日本abcin"]
    (image,) = rows[1]["images"]
    assert (image["width"], image["ext"]) == (2, "png") and image["bbox"]["x1"] - image["bbox"]["x0"] == pytest.approx(50)
    assert unpng(image["image"])[2] == bytes([255, 0, 0] * 4)
    assert [(a["type"], a["uri"]) for a in Outline(Pdf(d.save())).annotations()] == [("Highlight", None), ("Link", "http://x.y")]
    with pytest.raises(ValueError):
        E.insert_text(d, 0, (0, 0), "日本")


BORDERED = b"\n".join([*(b"%d 40 m %d 120 l S" % (x, x) for x in (40, 170, 300)), *(b"40 %d m 300 %d l S" % (y, y) for y in (40, 80, 120)), *(b"BT /F1 12 Tf %d %d Td (%s) Tj ET" % (x, y, t) for x, y, t in ((50, 95, b"Name"), (180, 95, b"Value"), (50, 55, b"a|b"), (180, 55, b"42")))])


def parsed(content: bytes, **kw) -> Page:
    pdf = Pdf(content_page(content, **kw))
    return Page(pdf, pdf.pages()[0])


def found(content: bytes, strategy="lines"):
    p = parsed(content)
    names = ("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags")
    glyphs = layout.glyphs_of(dict(zip(names, map(list, zip(*p.glyphs)))))
    return tables.find(glyphs, p.rules, strategy)


def test_bordered_table():
    (t,) = found(BORDERED)
    assert tables.extract(t) == [["Name", "Value"], ["a|b", "42"]] and t["confidence"] == 1.0
    assert tables.to_markdown(tables.extract(t)) == "| Name | Value |\n| --- | --- |\n| a\\|b | 42 |"


def test_merged_cell_and_broken_grid():
    merged = BORDERED.replace(b"170 40 m 170 120 l S", b"170 40 m 170 80 l S")
    (t,) = found(merged)
    assert tables.extract(t)[0][1] is None and tables.extract(t)[1] == ["a|b", "42"]
    assert tables.to_markdown(tables.extract(t), True).splitlines()[0].count("Name Value") == 2
    assert found(BORDERED.replace(b"40 40 m 300 40 l S", b"40 40 m 100 40 l S")) == []


def test_filled_rules():
    bars = b"\n".join([*(b"%d 40 1 80 re f" % x for x in (40, 170, 300)), *(b"40 %d 260 1 re f" % y for y in (40, 80, 120))])
    p = parsed(bars)
    assert len(p.rules) == 6 and len(tables.grid_tables([], p.rules)) == 1


def test_text_table_confidence():
    rows = ((b"Name", b"Value"), (b"Alpha", b"42"), (b"Beta", b"7"))
    content = b"\n".join(b"BT /F1 12 Tf %d %d Td (%s) Tj ET" % (x, 200 - 30 * i, c) for i, r in enumerate(rows) for x, c in zip((40, 180), r))
    (t,) = found(content, "text")
    assert tables.extract(t) == [["Name", "Value"], ["Alpha", "42"], ["Beta", "7"]]
    assert t["confidence"] == pytest.approx(0.9333, abs=1e-3)
    with pytest.raises(ValueError):
        found(content, "other")


def lines_at(*rows):
    """(x, y, text) rows as glyph columns of size 10."""
    cols = [[] for _ in range(11)]
    for x, y, t in rows:
        for i, c in enumerate(t):
            for col, v in zip(cols, (c, x + 5.0 * i, float(y), 10.0, 5.0, 1.0, 0.0, 0, "F", "F", 0)):
                col.append(v)
    return dict(zip(("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags"), cols))


def test_two_columns_are_read_one_after_the_other():
    page = lines_at((60, 20, "A heading over the whole of the page, quite long"), (40, 50, "left one"), (220, 50, "right one"), (40, 62, "left two"), (220, 62, "right two"), (60, 100, "and a footer under the whole of it, quite long"))
    assert [layout.line_text(x) for x in layout.page_lines(page)] == ["A heading over the whole of the page, quite long", "left one", "left two", "right one", "right two", "and a footer under the whole of it, quite long"]


def test_vertical_cjk_columns():
    cols = [[] for _ in range(11)]
    for x, text in ((200, "縦書き"), (100, "二列目")):
        for i, c in enumerate(text):
            for col, v in zip(cols, (c, float(x), 50.0 + 10 * i, 10.0, 10.0, 1.0, 0.0, 0, "F", "F", 0)):
                col.append(v)
    page = dict(zip(("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags"), cols))
    assert [layout.line_text(x) for x in layout.page_lines(page)] == ["縦書き", "二列目"]


def test_line_fold_against_a_plain_loop():
    rows = [(40.0 + 30 * k, 8 * (k // 5) + 7 * k % 9, "w") for k in range(60)]
    page = lines_at(*rows)
    page["size"] = [6.0 if k % 3 == 0 else 10.0 for k in range(60)]
    got = [sorted(g.seq for g in x.glyphs) for x in layout.cluster_lines(layout.glyphs_of(page))]
    want, base = [], None
    for y, x, k in sorted((rows[k][1], rows[k][0], k) for k in range(60)):
        if base is None or abs(y - base) > 0.5 * page["size"][k]:
            want.append([])
            base = y
        want[-1].append(k)
    assert got == [sorted(w) for w in want]


def test_search_words_and_gaps():
    page = lines_at((40, 20, "one"), (60, 20, "two"), (40, 32, "oneone"))
    lines = layout.page_lines(page)
    assert layout.line_text(lines[0]) == "one two"
    assert len(layout.find_text(lines, "ONE")) == 3 and layout.find_text(lines, "e t")[0][:1] == (50.0,)
    with pytest.raises(ValueError):
        layout.find_text(lines, "")


def test_rotation_and_rendering():
    p = parsed(b"1 0 0 rg 0 0 100 100 re f", size=(200, 100), rotate=90)
    img = raster.pixmap(p, 1.0)
    assert img.shape == (200, 100, 4) and tuple(img[50, 50]) == (255, 0, 0, 255) and tuple(img[150, 50]) == (255, 255, 255, 255)
    assert raster.pixmap(p, 2.0, clip=(10.2, 10.2, 20.1, 20.1)).shape == (21, 21, 4)
    assert unpng(png(2, 1, bytes(8), 4))[3] == b"\0\0" and raster.svg(p).startswith("<svg")
    with pytest.raises(ValueError):
        raster.check_size(70_000, 10, 1)
    with pytest.raises(PdfFault):
        jpeg_header(b"no")


def test_numbers():
    assert [number(x) for x in (1.0, 0.12345, -0.00001, 10.5)] == ["1", "0.1235", "0", "10.5"] or number(0.12345) == "0.1234"


def test_form_fields():
    bodies = {1: b"<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[4 0 R 5 0 R 6 0 R]>>>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 9 9]>>", 3: b"<</Type/Page/Parent 2 0 R>>", 4: b"<</T(customer)/FT/Tx/V(x)>>", 5: b"<</T(agree)/FT/Btn/AP<</N<</Yes 3 0 R/Off 3 0 R>>>>>>", 6: b"<</T(person)/FT/Tx/Kids[7 0 R]>>", 7: b"<</T(first)/Parent 6 0 R>>"}
    data = raw(bodies)
    assert [(f["name"], f["type"]) for f in Outline(Pdf(data)).fields()] == [("agree", "checkbox"), ("customer", "text"), ("person.first", "text")]
    d = Draft(data)
    E.fill_form(d, data, {"customer": "new", "agree": True, "person.first": "P"})
    assert {f["name"]: f["value"] for f in Outline(Pdf(d.save())).fields()} == {"agree": "Yes", "customer": "new", "person.first": "P"}


def test_cells_take_words_by_their_centres():
    # A word across the inner border at x=170, its centre at 173: that decides, and it isn't torn apart.
    page = lines_at((163, 100, "over it"))
    rules = [*((x, 40.0, x, 120.0, False) for x in (40.0, 170.0, 300.0)), *((40.0, y, 300.0, y, True) for y in (40.0, 80.0, 120.0))]
    (t,) = tables.grid_tables(layout.glyphs_of(page), rules)
    assert tables.extract(t) == [["", ""], ["", "over it"]]


def test_merged_cells_span_the_fewest_slots():
    # Row 0: the first cell spans two narrow columns (wide area) or two rows (fewer slots are tried by number, not by size).
    rules = [(0.0, 0.0, 0.0, 300.0, False), (200.0, 0.0, 200.0, 300.0, False), (10.0, 200.0, 10.0, 300.0, False), (0.0, 0.0, 200.0, 0.0, True), (0.0, 200.0, 200.0, 200.0, True), (0.0, 300.0, 200.0, 300.0, True), (0.0, 250.0, 200.0, 250.0, True)]
    (t,) = tables.grid_tables([], rules)
    assert [(r, c) for r, c, box, _ in t["cells"] if box is not None] == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_clip_is_checked_and_tables_are_a_sequence():
    found_ = tables.Found([{"cells": [1, 2]}, {"cells": [3]}])
    assert len(found_) == 2 and found_[-1]["cells"] == [3] and len(found_[:1]) == 1 and found_.cells == [1, 2, 3] and [t["cells"] for t in found_] == [[1, 2], [3]]
    for clip in ((0, 0, 0, 5), (0, 0, float("nan"), 5), (9, 9, 1, 1)):
        with pytest.raises(ValueError):
            tables.find([], [], "lines", clip)


def test_wide_set_cjk_rows_stay_rows():
    cols = [[] for _ in range(11)]
    for r in range(4):
        for i, c in enumerate("\u6a2a\u66f8\u304d\u6587"):
            for col, v in zip(cols, (c, 40.0 + 16 * i, 50.0 + 11 * r, 10.0, 10.0, 1.0, 0.0, 0, "F", "F", 0)):
                col.append(v)
    page = dict(zip(("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags"), cols))
    got = layout.page_lines(page)
    assert len(got) == 4 and not any(x.vertical for x in got)
    assert layout.CJK.match("\ud55c") and not layout.CJK.match("a")


def test_bold_bullets_are_items_and_pages_can_be_chosen(spark):
    from vellumtide.operators import markdown
    from vellumtide.sources.pagesource import PageSource

    page = lines_at((40, 20, "\u2022 item"), (40, 32, "2) two"), (40, 60, "text"), (40, 72, "goes on"))
    page["flags"] = [16] * len(page["text"])
    assert markdown.page_markdown(layout.page_lines(page), {}) == "- item\n2. two\n\n**text** **goes on**"

    def expand(record):
        for n in range(3):
            big = lines_at((40, 20, f"page {n}"), (40, 60, "body of it all"))
            big["size"] = [20.0 if i < 6 and n else 10.0 for i in range(len(big["size"]))]
            yield {"doc_id": record["doc_id"], "pno": n, "page_count": 3, "width": 600.0, "height": 800.0, "rotation": 0, "glyphs": big, "rules": [], "images": [], "error": None}

    src = PageSource(spark.createDataFrame([(1,)], "doc_id long"), expand)
    kept = src.rows()
    for select, want in ((None, "page 0\n\nbody of it all\n\n# page 1\n\nbody of it all\n\n# page 2\n\nbody of it all"), ([-1, 0], "# page 2\n\nbody of it all\n\npage 0\n\nbody of it all"), ([0, 9], "page 0\n\nbody of it all")):
        assert markdown.documents(src, select).first()["markdown"] == want
        assert markdown.documents(kept, select).first()["markdown"] == want
    assert sorted(map(tuple, markdown.levels(src).collect())) == sorted(map(tuple, markdown.levels(kept).collect()))


def test_fixed_points(spark):
    from vellumtide.operators import structure

    chain = spark.createDataFrame([(str(i), str(i + 1) if i < 60 else None, "v" if i == 60 else None) for i in range(61)] + [("a", "b", None), ("b", "a", None), ("c", "gone", None)], "id string, parent string, value string")
    got = {r["id"]: (r["value"], r["error"] is not None) for r in structure.inherited(chain).collect()}
    assert all(got[str(i)] == ("v", False) for i in range(61)) and got["a"] == got["b"] == (None, True) and got["c"] == (None, False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (50, 51)], "src long, dst long")
    assert sorted(r["id"] for r in structure.reachable(edges, spark.createDataFrame([(0,)], "id long")).collect()) == list(range(13))
    names = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", "Tx" if i == 0 else None, None) for i in range(5)], "id long, parent long, name string, kind string, flags int")
    assert {r["id"]: r["full_name"] for r in structure.dotted_names(names).collect()}[4] == "n0.n1.n2.n3.n4"


def test_handle(spark, tmp_path):
    from vellumtide import errors
    from vellumtide.sources import handle

    (tmp_path / "a.pdf").write_bytes(three())
    with handle.open(spark, str(tmp_path)) as d:
        assert len(d) == 3 and "".join(d[-1].first()["glyphs"]["text"]) == "Page three" and d.peek().first()["version"] == "1.7"
        assert d.markdown([1]).first()["markdown"] == "Page two"
        drawn = d.render(scale=0.5, pages=[2, 0, 2, 9], workers=2).orderBy("ord").collect()
        assert [(r["pno"], r["error"] is None) for r in drawn] == [(2, True), (0, True), (2, True), (9, False)] and drawn[0]["png"] == drawn[2]["png"] != drawn[1]["png"]
        with pytest.raises(IndexError):
            d.page(7)
    with pytest.raises(errors.HandleClosed):
        d.pages()
    locked = handle.Documents(spark.createDataFrame([("x", bytearray(Draft(three()).save(user_pw="u", owner_pw="o")))], "doc_id string, content binary"))
    with pytest.raises(errors.StillEncrypted):
        locked.text()
    assert locked.authenticate("u").text().count() == 3 and len(handle.empty(spark)) == 0
    with pytest.raises(ValueError):
        handle.open(spark)
    (p,) = raster.pixmaps(spark.createDataFrame([("x", bytearray(three()))], "doc_id string, content binary"), pages=[0], clip=(0, 0, 20, 10)).collect()
    assert (p["width"], p["height"], p["n"], p["stride"], len(p["samples"])) == (20, 10, 4, 80, 800)


def flat_operators(glyphs):
    """What the operators on pages give for a flat page, and what the plain loops give for it."""
    from vellumtide.operators import markdown
    from vellumtide.operators.flat import FlatPage

    page, made = FlatPage.of(glyphs), []

    class Catch:
        def per_page_columns(self, make, columns):
            made.append(make)

    pages, keep = Catch(), layout.PageSource.of
    layout.PageSource.of = staticmethod(lambda p: p)
    try:
        for f in (layout.words, layout.blocks, layout.spans, layout.page_text, layout.lines, layout.line_segments, lambda p: layout.search(p, "o W"), lambda p: layout.search(p, "aa")):
            f(pages)
    finally:
        layout.PageSource.of = keep
    plain = lambda v: v.to_pylist() if hasattr(v, "to_pylist") else v.tolist() if hasattr(v, "tolist") else list(v)
    rows = lambda got: list(zip(*map(plain, got))) if got is not None else []
    fast = [rows(m({"glyphs": glyphs})) for m in made] + [markdown.page_markdown(markdown._Laid.of(glyphs), {20.0: 1}), list(markdown._Laid.of(glyphs).counts.items())]
    of, FlatPage.of = FlatPage.of, classmethod(lambda cls, g: None)
    try:
        slow = [rows(m({"glyphs": glyphs})) for m in made] + [markdown.page_markdown(markdown._Laid.of(glyphs), {20.0: 1}), list(markdown._Laid.of(glyphs).counts.items())]
    finally:
        FlatPage.of = of
    return page, fast, slow


def test_flat_pages_are_laid_out_like_any_other():
    import random

    r, flat = random.Random(5), 0
    for trial in range(120):
        cols: list[list] = [[] for _ in range(11)]
        two, jitter = trial % 3 == 0, trial % 4 == 1
        for n in range(r.randint(0, 14)):
            x, y = (40.0 if not two or n % 2 else 400.0) + r.choice((0, 0, 3.3)), 12.0 * (n // 2 if two else n) + 12 + r.choice((0, 0, 0.7, 30))
            for c in "".join(r.choice(("aa", "Wo", " ", "  ", "word", "é", "日本", "İ", "Σ", "　", "- ", "1. ")) for _ in range(r.randint(0, 9))):
                size = r.choice((10.0, 10.0, 10.0, 20.0, 10.05, 0.5)) if jitter else (10.0 if n else 20.0)
                for col, v in zip(cols, (c, x, y + (r.choice((0, 0.2, 4.9, 5.3)) if jitter else 0), size, size / 2, 1.0, 0.0, 0, r.choice("FFFFG") if trial % 5 == 2 else "F", "Font", r.choice((0, 0, 16)) if trial % 5 == 2 else 0)):
                    col.append(v)
                x += size / 2 + r.choice((0, 0, 0, 0, 1.0, 2.2, 25.0, -3.0 if jitter else 0))
        names = ("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags")
        if trial % 7 == 3:
            order = r.sample(range(len(cols[0])), len(cols[0]))
            cols = [[c[i] for i in order] for c in cols]
        page, fast, slow = flat_operators(dict(zip(names, cols)))
        flat += page is not None
        assert fast == slow, trial
    assert flat > 80


def test_strings_set_at_once_are_set_like_single_characters(monkeypatch):
    import random
    import re

    from vellumtide.sources import pdfpage

    r = random.Random(6)
    fonts = [b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 0/LastChar 255/Widths[" + b"500 " * 256 + b"]/Encoding/WinAnsiEncoding>>", b"<</Type/Font/Subtype/Type1/BaseFont/Odd/FirstChar 97/Widths[300 450.5 0]>>", b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding<</Differences[97/fi/a/nothing/eacute]>>>>"]
    for trial in range(60):
        ops = []
        for _ in range(r.randint(1, 8)):
            text = bytes(r.choice(b"abcd efg\xe9\x81\xa0\x27") for _ in range(r.choice((0, 3, 12, 40))))
            shown = b"[(" + text + b") -120 (" + text[::-1] + b")] TJ" if r.random() < 0.3 else b"(" + text + b")" + r.choice((b" Tj", b"Tj", b" '"))
            matrix = r.choice((b"1 0 0 1", b"1 0 0 1", b"2 0 0 1.5", b"0 1 -1 0", b".9 .1 -.1 .9"))
            extra = r.choice((b"", b"", b"", b"2 Tc ", b"3 Tw ", b"80 Tz ", b"4 Ts "))
            ops.append(r.choice((b"BT /F1 10 Tf ", b"q BT /F1 11.5 Tf ")) + extra + matrix + b" %d %d Tm " % (r.randint(0, 300), r.randint(0, 300)) + shown + b" ET" + r.choice((b"", b" Q", b" % note")))
        data = content_page(b"\n".join(ops)).replace(b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", r.choice(fonts))
        fast = Page(pdf := Pdf(data), pdf.pages()[0]).glyphs
        with monkeypatch.context() as m:
            m.setattr(pdfpage, "SHORT", 10**9)
            m.setattr(pdfpage, "_TEXT_LINE", re.compile(rb"(?!)"))
            slow = Page(pdf := Pdf(data), pdf.pages()[0]).glyphs
        assert repr(fast) == repr(slow), trial


def test_files_take_one_pass_and_leave_in_small_batches(spark):
    from vellumtide.plans import catalog
    from vellumtide.sources.pagesource import CHARACTERS, arrow_schema, batches

    for name, most in (("insert_text", 1), ("show_page", 1), ("ocr_layer", 1), ("structure_roundtrip", 1), ("render_png", 1), ("merge_files", 3)):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("MapInPandas") + plan.count("FlatMapGroupsInPandas") == most, name
    rows = (((i,), [["x"] * 3], CHARACTERS) for i in range(9))
    got = list(batches(rows, arrow_schema("doc_id long, t string")))
    assert len(got) > 3 and sum(b.num_rows for b in got) == 27


def test_common_pages_make_no_object_a_glyph(monkeypatch):
    from vellumtide.operators.flat import FlatPage
    from vellumtide.sources import typesetter

    monkeypatch.setattr(layout, "Glyph", None)
    page = FlatPage.of(typesetter.set_page("one two\nthree")[0])
    assert page.words()[1].to_pylist() == ["one", "two", "three"] and page.line_texts() == ["one two", "three"]
    (row,) = page_rows("d", text_document([[(40, 20, 10, "a long enough line (x)")]]))
    assert FlatPage.of(row["glyphs"]).line_texts() == ["a long enough line (x)"]
