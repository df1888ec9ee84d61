from quirelens.operators import features, layout
from quirelens.sources import page_xml


def test_feature_table(spark):
    runs = "".join(f'<text top="{t}" left="50" width="200" height="10" font="0">two words</text>' for t in (100, 112, 124, 136))
    page = f'<page width="300" height="200"><fontspec id="0" size="9" family="T" color="#0"/><image top="0" left="0" width="10" height="10" src="x"/>{runs}</page>'
    xml = f"<pdf2xml>{page}<page width='300' height='200'><text top='1' left='1' width='9' height='9' font='0'><b>© bold</b></text></page></pdf2xml>"
    elements = page_xml.read(spark.createDataFrame([("a", xml.encode()), ("b", None)], "doc_id string, xml binary")).cache()
    wide = features.assemble(elements, layout.boxes(elements))
    got = {r.doc_id: r for r in features.vector(wide).collect()}
    a, b = got["a"], got["b"]
    assert (a.count_pages, a.count_fonts, a.main_font_size, a.perc_main_font_word, a.copyright_symbol) == (2, 1, 9, 1, 1)
    assert (a.mean_blockstyles_pp, a.mean_lines_per_blockstyle, a.mean_textboxes_pp, a.mean_lines_pp, a.mean_words_pp) == (0.5, 4, 0.5, 2.5, 5)
    assert (a.modal_left, a.perc_modal_left, a.modal_right, a.max_right, a.min_left) == (50, 0.8, 250, 250, 1)
    assert (a.mean_images_pp, a.mean_image_space_pp, a.mean_blockstyle_space_pp) == (0.5, 100 / 120000, 200 * 46 / 2)
    assert (a.mean_bold_words_pp, a.first_100_words.split()[0], a.bold_text, a.file_size) == (1, "two", "© bold", -1)
    assert a.mean_free_space_pp == (120000 - 100 - 200 * 46 - 81) / 120000
    assert b.text == b.first_100_words == "pw_protected" and b.count_pages == 0 and len(b.numeric) == 41


def test_page_xml_many_bad_lines_and_outlines():
    bad = "\n".join(f'<text top="{k}"><b>x</text>' for k in range(60))
    good = '<text top="99" left="1" width="2" height="3" font="0">kept</text>'
    xml = f"<pdf2xml>\n<page number=\"1\">\n{bad}\n{good}\n</page>\n<outline>\n<item>a</item>\n<outline>\n<item>b</item>\n</outline>\n</outline>\n<outline>\n<item>c</item>\n</outline>\n</pdf2xml>"
    got = page_xml.elements("d", xml.encode())
    assert [r["text"] for r in got if r["kind"] == "text"] == ["kept"] and sum(r["kind"] == "page" for r in got) == 1
    assert [r["text"] for r in got if r["kind"] == "item"] == ["a", "b", "c"] and sum(r["kind"] == "outline" for r in got) == 3
    assert page_xml.elements("d", b"<pdf2xml>\n<page>\n")[0]["error_code"] == "xml_error"


def test_elements_lines_boxes_and_pages_are_made_once(spark):
    """Many steps of the table read them; none of these may run the streams of layout or the search for tiny images again."""
    rows = [("a", 1, 100, 60, 0, "page", None, None, None, None, None, None, None), ("a", 1, 100, 60, 1, "text", 10, 5, 50, 10, 0, "two words", 0)]
    names = "doc_id string, page_no int, page_width int, page_height int, elem_seq int, kind string, top int, left int, width int, height int, font int, text string, fmt int"
    missing = "CAST(NULL AS int) AS size, '' AS family, '' AS color, '' AS bold_text, 0 AS n_bold_words, 0 AS n_links, CAST(NULL AS string) AS error_code"
    wide = features.assemble(spark.createDataFrame(rows, names).selectExpr("*", *missing.split(", ")))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("row_number") == 0
    row = wide.first()
    assert (row.mean_words_pp, row.mean_textboxes_pp, row.text) == (2, 1, "two words")


def test_slices_are_whole_and_leave_no_files_behind(spark, sf_dir, monkeypatch):
    """The feature table in many slices of documents is that of one, and of what a slice writes only its rows stay."""
    import glob

    from quirelens import runtime
    from quirelens.plans import layouts

    def files():
        return set(glob.glob(runtime.shared_folder(spark).removeprefix("file:") + "/**/*.parquet", recursive=True))

    whole = sorted(layouts.feature_table(spark, sf_dir).collect())
    monkeypatch.setattr(layouts, "SLICE_ROWS", 2_500)  # of about 6,000
    before, seen, step = files(), [], features.assemble
    monkeypatch.setattr(features, "assemble", lambda elements, **given: (seen.append(len(files() - before)), step(elements, **given))[1])
    sliced = layouts.feature_table(spark, sf_dir)
    left = files() - before
    assert sorted(sliced.collect()) == whole and len(whole) > 20
    assert len(seen) == 3 and seen[0] == 0  # no elements are written before the first slice
    assert left == set(sliced.inputFiles()) or {x.rpartition("/")[2] for x in left} == {x.rpartition("/")[2] for x in sliced.inputFiles()}
