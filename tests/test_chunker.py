"""HTML as trees, elements and tables in parts, and the whole chunker against a plain loop over each document."""

import random
import re

import pytest

from folioflow.functions.html import parsed
from folioflow.operators import markdown, tree
from folioflow.operators.folds import split_text


@pytest.mark.parametrize(
    "html, written",
    [
        ("<P CLASS='a  b' id=x id=y>A &amp; B<br>C</p>", '<p class="a b" id="y">A &amp; B<br/>C</p>'),
        ("<script>if (a < b && c) {}</script>", "<script>if (a < b && c) {}</script>"),
        ("<!DOCTYPE html><!-- x < y --><?php z ?>t", "<!DOCTYPE html>\n<!-- x < y --><?php z ?>t"),
        ("<tr>  \n <td nowrap>1   <td>2", '<tr>\n<td nowrap="">1   <td>2</td></td></tr>'),
        ("<pre>  \n </pre><b>   </b>", "<pre>  \n </pre><b> </b>"),
        ("a</br><br></br><img src='x\"y'/>&nbsp;&bogus;&#150;&#x41;&lt;", "a<br/><img src='x\"y'/>\xa0&amp;bogus–A&lt;"),
        ("</b><i>x</u></i><div/>y", "<i>x</i><div></div>y"),
        ("<b>x<i>y</b>z</i>", "<b>x<i>y</i></b>z"),
        ("", ""),
        ("<" * 50 + "a" * 5, "&lt;" * 49 + "&lt;aaaaa"),
    ],
)
def test_html_is_written_in_one_form(html, written):
    assert parsed(html).inner() == written


def test_html_of_any_depth():
    deep = "<b>" * 20_000 + "x"
    tree_ = parsed(deep)
    assert tree_.inner() == deep + "</b>" * 20_000 and tree_.text() == "x" and sum(1 for _ in tree_.below()) == 20_000


def test_fields_are_direct_children_as_text():
    block = '<BILD img_path="images/a&amp;b.png">\n<caption_text>A &amp; B <b>x</b></caption_text>\n<content><table><tr><td>1<caption_text>no</caption_text></td></tr></table></content><description><!-- c -->d</description></BILD>'
    kind, known = markdown.element_fields(block)
    assert kind == "bild" and known["asset_path"] == "images/a&b.png" and known["caption"] == "A & B x" and known["description"] == "d" and known["summary"] == ""
    assert known["body"] == "<table><tr><td>1<caption_text>no</caption_text></td></tr></table>"
    assert markdown.element_fields(" <table><tr></table> ") == ("", {"body": "<table><tr></table>"})


def test_rows_without_an_end_stay():
    parts = markdown.table_parts("<table><tr><td>one</td></tr><tr><td>two</td></tr><tr><td>last</td></table>", 30)
    assert parts == ["<table>\n\n<tr><td>one</td></tr>\n</table>", "<table>\n<tr><td>two</td></tr>\n</table>", "<table>\n<tr><td>last</td></tr>\n</table>"]
    assert markdown.table_parts("<table>no rows</table>", 30) == ["<table>\nno rows\n</table>"]
    nested = "<tr><td><table><tr><td>in</td></tr></table></td></tr>"
    assert markdown.table_parts(f"<table><tbody>{nested}</tbody></table>", 500) == [f"<table>\n{nested}\n<tr><td>in</td></tr>\n</table>"]


PAGE = re.compile(markdown.PAGE)


def plain_parents(sections, elements, most):
    """Sections (h1, h2, text) of one document with neighbours joined, elements put back, long ones cut."""
    rows = [list(s) for s in sections]
    for i in range(len(rows) - 2, -1, -1):
        if not re.sub(r"__SPECIAL_ELEMENT_PLACEHOLDER_\d+__", "", PAGE.sub("", rows[i][2])).strip():
            rows[i + 1][2] = rows[i][2] + "\n\n" + rows[i + 1][2]
            del rows[i]
    out, waiting = [], None
    for h1, h2, text in rows:
        text = text if waiting is None else waiting + "\n\n" + text
        bare = not re.sub(r"(?m)^#{1,6}\s+.*$", "", PAGE.sub("", text)).strip()
        waiting, last = (text, (h1, h2)) if bare else (None, None)
        if not bare:
            out.append([h1, h2, text])
    if waiting is not None:
        if out:
            out[-1][2] += "\n\n" + waiting
        else:
            out.append([*last, waiting])
    for row in out:
        row[2] = re.sub(r"__SPECIAL_ELEMENT_PLACEHOLDER_(\d+)__", lambda m: elements[int(m[1])], row[2])
    return [(h1, h2, part) for h1, h2, text in out for part in (split_text(text, most) if len(text) > most else [text])]


def plain_chunks(parents, headings, size):
    """What the chunker returns for one document's parents, in order."""
    up, stack, out = {}, [], []
    for title in headings:
        level = len(re.match(r"[\d.]+", title)[0].strip(".").split("."))
        while stack and stack[-1][0] >= level:
            stack.pop()
        up[title] = stack[-1][1] if stack else None
        stack.append((level, title))
    order = {t: i for i, t in reversed(list(enumerate(headings)))}

    def path_of(title):
        return [] if title is None else [*path_of(up[title]), title]

    def below(title):
        return [x for t in sorted((t for t in up if up[t] == title), key=order.get) for x in (t, *below(t))]

    top, path, subchapters = 1, [], []
    for n, (h1, h2, text) in enumerate(parents):
        hits = [t for t in sorted(up, key=order.get) if re.search(rf"(?m)^(?:#+\s*)?{re.escape(t)}\s*$", text)]
        if hits:
            path = path_of(hits[-1])
            subchapters = [path[0], *below(path[0])]
        marks = [(m.start(), int(m[1])) for m in PAGE.finditer(text)]
        start = marks[0][1] if marks and not text[: marks[0][0]].strip() else top
        top = max([top, *[p for _, p in marks]])
        pages = sorted({start, *[p for _, p in marks]})
        subs = []
        for i, s in enumerate(markdown.sub_chunks(text, size)):
            here = next((p for at, p in reversed(marks) if at <= s["start"]), start)
            found = sorted({here, *[int(p) for p in PAGE.findall(s["content"])]})
            subs.append({"id": i, "text": s["content"], "kind": s["chunk_type"], "pages": found, "assets": [], "texts": [], "path": s.get("asset_path")})
        for a, b in zip(subs, subs[1:]):
            if a["kind"] == "text" != b["kind"]:
                a["assets"].append(b["id"])
                b["texts"].append(a["id"])
            elif b["kind"] == "text" != a["kind"]:
                b["assets"].append(a["id"])
                a["texts"].append(b["id"])
        raw = h2 if h2 is not None else h1
        kept, i = [], 0
        while i < len(subs):
            s = subs[i]
            if s["kind"] == "text" and raw is not None and re.sub(r"#+\s*", "", s["text"]).strip() == raw.strip() and i + 1 < len(subs):
                subs[i + 1]["text"] = s["text"] + "\n\n" + subs[i + 1]["text"]
            else:
                kept.append(s)
            i += 1
        if not kept:
            kept = [{"id": 0, "text": text, "kind": "text", "pages": pages, "assets": [], "texts": [], "path": None}]
        shown = re.sub(r'(<(?:BILD|TABELLE)) img_path="[^"]*"', r"\1", text)
        out += [(n, shown, pages, path, subchapters, s["id"], s["text"], s["kind"], s["pages"], s["path"], sorted(s["assets"]), sorted(s["texts"])) for s in kept]
    return out


def test_chunker_equals_a_plain_loop(spark):
    rng = random.Random(5)
    figure = '<BILD img_path="images/{0}.png"><caption_text>C &amp; {0}</caption_text><summary>s {0}</summary><content>{1}</content></BILD>'
    pieces = [
        lambda: f"# {rng.choice(titles)}", lambda: f"## {rng.choice(titles)}", lambda: f"### {rng.choice(titles)}", lambda: f'<seite nummer="{rng.randint(1, 9)}" />',
        lambda: "words " * rng.randint(1, 60), lambda: "", lambda: figure.format(rng.randint(1, 9), "x " * rng.randint(0, 40)),
        lambda: "<table>" + "".join(f"<tr><td>{rng.random()}</td>" + rng.choice(["</tr>", ""]) for _ in range(rng.randint(0, 9))) + "</table>",
        lambda: '<TABELLE img_path="t.png"><summary>about</summary><content><table><tbody><tr><td>1</td></tr></tbody></table></content></TABELLE>',
        lambda: "<tr><td>loose</td>", lambda: rng.choice(titles),
    ]
    titles = ["1 Alpha", "1.1 Beta", "1.2 Gamma", "2 Delta", "2.1.1 Epsilon", "3 Zeta", "Plain"]
    texts = ["\n".join(rng.choice(pieces)() for _ in range(rng.randint(0, 14))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")
    listed = {i: rng.sample(titles[:6], rng.randint(0, 6)) for i in range(len(texts))}
    items = spark.createDataFrame([(i, p, "text", 1, t) for i, ts in listed.items() for p, t in enumerate(ts)], "doc_id int, pos int, type string, text_level int, text string")
    size, most = 120, 400
    found = markdown.chunk_documents(docs, items, size=size, most=most).collect()
    bodies, elements = markdown.isolated(docs)
    sections, held = {}, {}
    for r in sorted(markdown.header_sections(bodies).collect(), key=lambda r: r["section"]):
        sections.setdefault(r["doc_id"], []).append((r["h1"], r["h2"], r["text"]))
    for r in elements.collect():
        held.setdefault(r["doc_id"], {})[r["number"]] = r["element"]
    columns = ["chunk", "text", "page_numbers", "toc_path", "all_subchapters", "sub_id", "sub_text", "chunk_type", "sub_page_numbers", "asset_path"]
    ours, theirs = {}, {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["chunk"], r["sub"])):
        ours.setdefault(r["doc_id"], []).append((*(r[c] for c in columns), sorted(r["related_assets"]), sorted(r["related_text"])))
    for d, rows in sections.items():
        if chunks := plain_chunks(plain_parents(rows, held.get(d, {}), most), listed[d], size):
            theirs[d] = chunks
    assert len(ours) > 100 and sum(map(len, ours.values())) > 400
    for d in sorted({*ours, *theirs}):
        assert ours.get(d) == theirs.get(d), (d, texts[d])
    assert any(r["related_assets"] for r in found) and any(len(r["toc_path"]) > 1 for r in found)


def test_repeated_titles_have_one_path(spark):
    rows = [(0, p, "text", 1, t) for p, t in enumerate(["1 A", "1.1 B", "2 C", "2.1 D", "1.1 B"])]
    items = spark.createDataFrame(rows, "doc_id int, pos int, type string, text_level int, text string")
    paths = {r["title"]: r["path"] for r in tree.contents_paths(tree.contents_parents(tree.numbered_headings(items))).collect()}
    assert paths["1.1 B"] == ["2 C", "1.1 B"]
