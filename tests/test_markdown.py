"""The chunker, heading trees, page marks, replacements and layout documents on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import layout_json, markdown, tree


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")


def chunks_of(spark, text, **params):
    rows = markdown.chunk_documents(docs(spark, text), **params).collect()
    return sorted(rows, key=lambda r: (r["chunk"], r["sub"]))


def test_sections_merge_forward(spark):
    text = "# A\n\n## B\n<table><tr><td>1</td></tr></table>\n\ntext b\n# C\n<BILD x>p</BILD>\n# D\ntail\n## E\n### F"
    parents = sorted(markdown.parent_chunks(docs(spark, text)).collect(), key=lambda r: r["chunk"])
    # A is a heading alone: it joins B.  C is a heading and a figure: neither bare nor heading alone.  E joins what is before.
    assert [(r["h1"], r["h2"], r["header"]) for r in parents] == [("A", "B", "B"), ("C", None, "C"), ("D", None, "D")]
    assert parents[0]["text"].startswith("# A\n\n## B\n") and "<table><tr><td>1</td></tr></table>" in parents[0]["text"]
    assert parents[1]["text"].endswith("<BILD x>p</BILD>") and parents[2]["text"] == "# D\ntail\n\n## E\n### F"


def test_placeholder_sections_join_the_next(spark):
    text = "<BILD a>x</BILD>\n# A\ntext\n"
    parents = markdown.parent_chunks(docs(spark, text)).collect()
    assert [(r["h1"], r["text"]) for r in parents] == [("A", "<BILD a>x</BILD>\n\n# A\ntext")]
    only = markdown.parent_chunks(docs(spark, "<BILD a>x</BILD>", "", "# H")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in only) == [(0, "<BILD a>x</BILD>"), (2, "# H")]


def test_second_level_ends_with_the_first(spark):
    rows = markdown.header_sections(docs(spark, "a\n# A\n## B\nx\n# C\ny\n  ## D\nz\n#no\n### deep")).collect()
    assert [(r["h1"], r["h2"]) for r in sorted(rows, key=lambda r: r["section"])] == [(None, None), ("A", None), ("A", "B"), ("C", None), ("C", "D")]


def test_sub_chunks_and_pages(spark):
    figure = '<BILD img_path="images/p.png"><summary> s </summary><description>d</description><content><b>c</b></content></BILD>'
    text = f'# A\n<seite nummer="3" />\nfirst\n{figure}\nlast <seite nummer="4" /> end'
    rows = chunks_of(spark, text)
    assert [(r["chunk_type"], r["sub_page_numbers"]) for r in rows] == [("text", [1, 3]), ("image", [3]), ("text", [3, 4])]
    assert rows[1]["sub_text"] == "<summary>s</summary>\n<description>d</description>\n<content><b>c</b></content>"
    assert (rows[1]["asset_path"], rows[1]["summary"], rows[1]["body"]) == ("images/p.png", "s", "<b>c</b>")
    assert rows[0]["page_numbers"] == [1, 3, 4] and rows[0]["header"] == "A" and "img_path" not in rows[0]["text"]
    leads = chunks_of(spark, '<seite nummer="3" />text')
    assert leads[0]["page_numbers"] == [3] and leads[0]["sub_page_numbers"] == [3]


def test_elements_without_path_are_no_elements():
    kinds = [s["chunk_type"] for s in markdown.sub_chunks("a <TABELLE>x</TABELLE> <table><tr><td>1</td></tr></table>", 2000)]
    assert kinds == ["text", "table"]


def test_long_elements_split_by_component_and_row():
    rows = "".join(f"<tr><td>{i:04d}</td></tr>" for i in range(10))
    subs = markdown.sub_chunks(f'<TABELLE img_path="t.png"><caption_text>cap</caption_text><summary>sum</summary><content><table>{rows}</table></content></TABELLE>', 100)
    texts = [s["content"] for s in subs]
    assert texts[:2] == ["<caption_text>cap</caption_text>", "<summary>sum</summary>"] and all(s["chunk_type"] == "table" for s in subs)
    assert texts[2].startswith("<table>\n\n<tr><td>0000") and sum(t.count("<tr>") for t in texts[2:]) == 10 and all(t.endswith("</table>") for t in texts[2:])
    assert markdown.table_parts("<table>none</table>", 5) == ["<table>\nnone\n</table>"]
    long = markdown.sub_chunks('<BILD img_path="p"><summary>' + "s " * 60 + "</summary></BILD>", 100)
    assert len(long) > 1 and all(s["chunk_type"] == "image" for s in long) and long[0]["content"].startswith("<summary>")


def test_a_repeated_heading_joins_the_next_sub_chunk(spark):
    rows = chunks_of(spark, '# A\n<table><tr><td>1</td></tr></table>\ntext')
    # elements stand apart by blank lines, and so does the heading from what it joins
    assert [r["sub_text"] for r in rows] == ["# A\n\n\n\n\n<table><tr><td>1</td></tr></table>", "\n\n\ntext"] and rows[0]["chunk_type"] == "table"


def test_exact_size_is_not_split(spark):
    text = "x" * 50
    assert len(chunks_of(spark, text, size=50)) == 1 and len(chunks_of(spark, text + " y", size=50)) > 1
    big = "# A\n" + "word " * 30
    assert len({r["chunk"] for r in chunks_of(spark, big, most=60)}) > 1


def test_page_marks_go_before_the_first_element_of_a_page():
    text = "Intro text\n\n## Second head\nbody ![x](images/a.png) end\n<table><tr><td>1</td></tr></table>"
    items = [(0, "text", "Intro   text", None, None), (1, "text", "Second head", None, None), (2, "image", None, None, "images/a.png"), (3, "table", None, "<table><tr> <td>1</td></tr></table>", None), (4, "text", "absent", None, None)]
    out = markdown.place_pages(text, items)
    assert out.startswith('<seite nummer="1" />\n\nIntro text') and '<seite nummer="2" />\n\n## Second head' in out
    assert 'body <seite nummer="3" />\n\n![x](images/a.png)' in out and 'nummer="5"' not in out
    # the pattern allows white space where the element has some, so this table has no place
    assert 'nummer="4"' not in out and markdown.place_pages(text, []) == text
    # the search never moves back
    assert 'nummer="3"' not in markdown.place_pages("b a", [(1, "text", "a", None, None), (2, "text", "b", None, None)])


def test_removals_and_replacements():
    text = 'a ![x](images/a.png) <TABELLE img_path="images/a.png" />\n\n<BILD img_path="images/a.png">z</BILD>\nb ![y](images/b.png) <table>t</table>'
    assert markdown.without_elements(text, ["images/a.png"], ["<table>t</table>"], ["b.png"]) == "a  b ![y](images/b.png) "
    assert markdown.replace_once("x ab a ab", {"a": "1", "ab": "2", " ": "3"}) == "x 2 1 ab"
    assert markdown.replace_once("a b", {"a": "1" * 100, "b": "2"}, growth=1, least_limit=10) == "1" * 100 + " b"


def test_parts_count_pages_on(spark):
    mark = lambda n, end=" />": f'<seite nummer="{n}"{end}'
    rows = [(1, 0, 0, f"{mark(1)}a"), (1, 1, 50, f"{mark(1)}b{mark(2, '/>')}c{mark(2)}"), (2, 0, 9, mark(1))]
    found = {r["doc_id"]: r["markdown"] for r in markdown.joined_parts(spark.createDataFrame(rows, "doc_id int, part int, page_offset int, markdown string")).collect()}
    assert found == {1: f"{mark(1)}a{mark(51)}b{mark(2, '/>')}c{mark(52)}", 2: mark(1)}


def test_contents_paths_and_chunks(spark):
    titles = ["1 A", "1.1 B", "1.1.1 C", "1.2 D", "2 E", "no number", "1.1 B"]
    items = spark.createDataFrame([(1, i, "text", 1, t) for i, t in enumerate(titles)], "doc_id int, pos int, type string, text_level int, text string")
    parents = tree.contents_parents(tree.numbered_headings(items))
    # the title that repeats has its first place and its last parent
    assert {r["title"]: (r["ord"], r["parent"]) for r in parents.collect()} == {"1 A": (0, tree.ROOT), "1.1 B": (1, "2 E"), "1.1.1 C": (2, "1.1 B"), "1.2 D": (3, "1 A"), "2 E": (4, tree.ROOT)}
    paths = tree.contents_paths(parents)
    chunks = spark.createDataFrame([(1, 0, "intro"), (1, 1, "# 1 A\ntext 2 E inside"), (1, 2, "nothing"), (1, 3, "## 1.1.1 C  \nx"), (1, 4, "1.2 D")], "doc_id int, chunk int, text string")
    found = {r["chunk"]: (r["toc_path"], r["all_subchapters"]) for r in tree.chunk_paths(chunks, paths).collect()}
    assert found[0] == ([], []) and found[1] == (["1 A"], ["1 A", "1.2 D"]) and found[2] == found[1]
    assert found[3] == (["2 E", "1.1 B", "1.1.1 C"], ["2 E", "1.1 B", "1.1.1 C"]) and found[4] == (["1 A", "1.2 D"], ["1 A", "1.2 D"])


def test_small_subtrees_take_in_what_is_below(spark):
    rows = [(1, 1, 1, "A", 9), (1, 2, 2, "B", 3), (1, 3, 3, "C", 1), (1, 4, 2, "D", 5), (1, 5, 3, " ", 4), (1, 6, 1, "E", 1)]
    nodes = spark.createDataFrame(rows, "doc_id int, line int, level int, text string, total_tokens int")
    assert sorted((r["line"], r["level"], r["text"]) for r in tree.thinned(nodes, 4).collect()) == [(1, 1, "A"), (2, 2, "B\n\nC"), (4, 2, "D"), (5, 3, " "), (6, 1, "E")]
    assert [(r["line"], r["text"]) for r in tree.thinned(nodes.where("line < 6"), 10).collect()] == [(1, "A\n\nB\n\nC\n\nD")]


def test_summaries_by_batches(spark):
    marks = "".join(f'<seite nummer="{i}" />p{i}' for i in range(1, 31))
    told = {r["document_id"]: r["summary"] for r in tree.document_summaries(docs(spark, marks, "no pages"), lambda t: F.concat(F.lit("<"), F.length(t), F.lit(">")), F.upper).collect()}
    assert told[1] == "" and told[0].count("<") == 5 and len(told[0].split("\n")) == 5
    two = "".join(f'<seite nummer="{i}" />p' for i in range(1, 27))
    said = lambda t: F.when(t.contains('"26"'), "last").otherwise("")
    assert tree.document_summaries(docs(spark, two), said, F.upper, group=25).first()["summary"] == "last"


def test_layout_walk(spark):
    columns = "doc_id int, item int, ref string, kind string, parent string, label string, content_layer string, text string, marker string, page_no int, children array<string>, bbox array<double>"
    rows = [
        (1, 0, "#/texts/0", "texts", "#/body", "section_header", "body", "Head", None, 1, [], None),
        (1, 0, "#/groups/0", "groups", "#/body", "list", "body", None, None, None, ["#/texts/1", "#/texts/9"], None),
        (1, 1, "#/texts/1", "texts", "#/groups/0", "list_item", "body", "item", "1.", 2, [], None),
        (1, 0, "#/pictures/0", "pictures", "#/body", "picture", "body", None, None, 2, ["#/texts/2", "#/texts/3"], None),
        (1, 2, "#/texts/2", "texts", "#/pictures/0", "text", "body", "seen by OCR", None, 2, [], None),
        (1, 3, "#/texts/3", "texts", "#/pictures/0", "caption", "body", "Abbildung 3", None, 2, [], None),
        (1, 4, "#/texts/4", "texts", "#/body", "Page_Footer", "body", "foot", None, 2, [], None),
        (1, 0, "#/tables/0", "tables", "#/body", "table", "body", None, None, 1, [], None),
    ]
    items = spark.createDataFrame(rows, columns)
    meta = spark.createDataFrame([(1, "#/pictures/0", 0, None, None, "p.png", None), (1, None, 7, "t.png", "<table/>", None, None), (1, "#/tables/0", 1, None, "<table/>", None, None)], "doc_id int, self_ref string, ord int, img_path string, html string, filename string, caption string")
    body = spark.createDataFrame([(1, ["#/texts/0", "#/groups/0", "#/pictures/0", "#/texts/4", "#/tables/0", "#/missing/0"])], "doc_id int, body array<string>")
    captions = spark.createDataFrame([(1, "#/pictures/0", "Abbildung 3"), (1, "#/tables/0", "Table one")], "doc_id int, ref string, caption string")
    found = layout_json.to_markdown(layout_json.walk(body, layout_json.with_metadata(items, meta)), captions).first()["markdown"]
    parts = ['\n<seite nummer="1" />\n', "\n## Head\n", '\n<seite nummer="2" />\n', "1. item", "\n![Image 1](images/p.png)\n", "\nTable one\n", "\n<TABELLE>\n<caption_text>Table one</caption_text>\n<table/>\n</TABELLE>\n"]
    assert found == "\n".join(parts)


def test_contents_of_any_depth(spark):
    """A chain of a hundred levels, a junk line of a thousand dots, and titles whose parents go in a circle."""
    deep = [(1, i, ".".join(["1"] * (i + 1)) + f" t{i}") for i in range(100)]
    junk = [(2, 0, "1 a"), (2, 1, "1" + "." * 1000 + "5 x"), (2, 2, "1.1 b")]
    ring = [(3, 0, "1 a"), (3, 1, "1.1 b"), (3, 2, "1 c"), (3, 3, "1 b"), (3, 4, "1.1 a"), (3, 5, "1 a"), (3, 6, "1.1 1.1 b")]
    rows = [(d, p, "text", 1, t) for d, p, t in deep + junk + ring]
    items = spark.createDataFrame(rows, "doc_id int, pos int, type string, text_level int, text string")
    paths = {(r["doc_id"], r["title"]): r["path"] for r in tree.contents_paths(tree.contents_parents(tree.numbered_headings(items))).collect()}
    titles = [t for _, _, t in deep]
    assert all(paths[1, t] == titles[: i + 1] for i, t in enumerate(titles))
    assert paths[2, "1" + "." * 1000 + "5 x"] == ["1 a", "1" + "." * 1000 + "5 x"] and paths[2, "1.1 b"] == ["1 a", "1.1 b"]
    assert paths[3, "1 a"] == ["1 a"]
    round_ = spark.createDataFrame([(1, "x", "y", 0, ["x"]), (1, "y", "x", 1, ["y"]), (1, "z", tree.ROOT, 2, ["z"])], "doc_id int, title string, parent string, ord int, p array<string>")
    assert [r["title"] for r in tree.contents_paths(round_.drop("p")).collect()] == ["z"]


def test_layout_of_any_depth(spark):
    columns = "doc_id int, item int, ref string, kind string, parent string, label string, content_layer string, text string, children array<string>"
    rows = [(d, i, f"#/groups/{i}", "groups", "", "list", "body", None, [f"#/groups/{i + 1}", f"#/texts/{i}"]) for d in (1, 2) for i in range(99)]
    rows += [(1, 99, "#/groups/99", "groups", "", "list", "body", None, ["#/texts/99"]), (2, 99, "#/groups/99", "groups", "", "list", "body", None, ["#/groups/50"])]
    rows += [(1, i, f"#/texts/{i}", "texts", "", "text", "body", f"t{i}", []) for i in range(100)]
    items = spark.createDataFrame(rows, columns)
    body = spark.createDataFrame([(1, ["#/groups/0"])], "doc_id int, body array<string>")
    found = layout_json.walk(body, items.where("doc_id = 1")).where("kind = 'texts'").orderBy("place").collect()
    assert [r["text"] for r in found] == [f"t{i}" for i in reversed(range(100))] and len(found[0]["place"]) == 101
    with pytest.raises(ValueError, match="below itself"):
        layout_json.walk(spark.createDataFrame([(2, ["#/groups/0"])], "doc_id int, body array<string>"), items.where("doc_id = 2"))


def test_nested_trees_round_trip(spark):
    import json

    rows = [(1, 1, None, 'A "q"', None), (1, 2, 1, "B", 5), (1, 3, 2, "C", None), (1, 9, 1, "D", 1), (1, 12, None, "E", 0), (2, 4, None, None, None), (2, 5, 4, "x", 2)]
    rows += [(3, i, i - 1 if i else None, f"t{i}", i) for i in range(60)] + [(4, 7, 6, "no parent", 1)]
    nodes = spark.createDataFrame(rows, "doc_id int, line int, parent int, title string, n int")
    trees = tree.nested_tree(nodes, ["title", "line", "n"])
    found = {r["doc_id"]: json.loads(r["tree"]) for r in trees.collect()}
    assert found[1] == [{"title": 'A "q"', "line": 1, "nodes": [{"title": "B", "line": 2, "n": 5, "nodes": [{"title": "C", "line": 3}]}, {"title": "D", "line": 9, "n": 1}]}, {"title": "E", "line": 12, "n": 0}]
    assert set(found) == {1, 2, 3} and list(found[1][0]) == ["title", "line", "nodes"]
    back = {(r["doc_id"], r["line"]): (r["title"], r["n"], len(r["place"])) for r in tree.flat_tree(trees, "title string, line int, n int").collect()}
    assert {k: v[:2] for k, v in back.items()} == {(r[0], r[1]): (r[3], r[4]) for r in rows if r[0] != 4}
    assert back[3, 59][2] == 60 and back[1, 3][2] == 3
    assert json.loads(tree.nested_tree(nodes.where("doc_id = 2"), ["n"]).first()["tree"]) == [{"nodes": [{"n": 2}]}]
