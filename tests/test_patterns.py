"""Many patterns in one text, and similar names of one content, against plain searches."""

import random
import re
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.functions.patterns import leftmost_longest, places
from folioflow.operators import catalog, enrich, markdown

SMALL = st.text(alphabet="ab c", max_size=40)


@settings(max_examples=500, deadline=None)
@given(SMALL, st.lists(st.text(alphabet="ab c", max_size=5), max_size=6))
def test_automaton_equals_plain_searches(text, strings):
    wanted = sorted({s for s in strings if s}, key=len, reverse=True)
    plain = [(m.start(), m[0]) for m in re.finditer("|".join(map(re.escape, wanted)), text)] if wanted else []
    assert list(leftmost_longest(text, strings)) == plain
    assert places(text, strings) == {s: found for s in wanted if (found := [i for i in range(len(text)) if text.startswith(s, i)])}


def plain_pages(text, items):
    """Element by element with a pattern that lets blanks differ."""
    at, first = 0, {}
    for page, kind, said, table, image in items:
        words = lambda t: r"\s+".join(map(re.escape, t.split()))
        pattern = None
        if kind in ("text", "title"):
            pattern = words(said) if said and said.strip() else None
        elif kind == "table" and table:
            pattern = words(table.strip()[:150]) or None
        elif kind in ("table", "image", "equation") and image and image.strip():
            pattern = r"!\[.*?\]\(images/" + re.escape(image.strip().removeprefix("images/")) + r"\)"
        if pattern and (m := re.compile(pattern).search(text, at)):
            first.setdefault(page, m.start())
            at = m.end()
    cuts, end = [], len(text)
    for page in sorted((p for p in first if p), reverse=True):
        cut = first[page]
        start = text.rfind("\n", 0, cut) + 1
        cut = min(start if text[start:].lstrip().startswith("#") else cut, end)
        cuts.append(f'<seite nummer="{page + 1}" />\n\n{text[cut:end]}')
        end = cut
    return f'<seite nummer="1" />\n\n{text[:end]}' + "".join(reversed(cuts)) if items else text


PIECE = st.sampled_from(["a", "b", "a b", "# a", "\n", "  ", "\u00a0", "![x](images/p.png)", "![", "](images/p.png)", "a  b", "\n\n# b c", "c"])
ITEM = st.tuples(st.integers(0, 4), st.sampled_from(["text", "title", "table", "image", "equation", "other"]), st.sampled_from([None, "", " a ", "a b", "b", "b c", "a\nb c"]), st.sampled_from([None, "a", "c a"]), st.sampled_from([None, "images/p.png", "p.png", "q.png"]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECE, max_size=25).map("".join), st.lists(ITEM, max_size=8))
def test_pages_equal_pattern_by_pattern(text, items):
    assert markdown.place_pages(text, items) == plain_pages(text, items)


def test_ten_thousand_patterns_are_one_pass():
    rng = random.Random(4)
    lines = [f"line {i} of {rng.random()}" for i in range(10_000)]
    text = "\n\n".join(lines)
    missing = [f"not there {i}" for i in range(10_000)]
    began = time.time()
    out = markdown.place_pages(text, [(i // 40, "text", t, None, None) for i, pair in enumerate(zip(lines, missing, strict=True)) for t in pair])
    assert out.count("<seite") == 250
    replaced = markdown.replace_once(text, {t: t.upper() for t in lines + missing}, growth=100)
    assert replaced == text.upper()
    assert time.time() - began < 20


def test_cells_inside_furniture_texts(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["Seite", "Amt", "1", "x", "Bescheid", "e"])
    cells = [(rng.randint(0, 5), rng.randint(0, 3), rng.choice([None, "", " ", f"{word()} {word()}", word()])) for _ in range(300)]
    texts = [(rng.randint(0, 4), rng.choice(["", f"{word()} {word()} {word()}"])) for _ in range(12)]
    found = enrich.furniture_tables(spark.createDataFrame(cells, "doc_id int, table_id int, cell string"), spark.createDataFrame(texts, "doc_id int, text string"))
    expected = set()
    for d, t in {(d, t) for d, t, _ in cells}:
        held = [x for e, x in texts if e == d and x]
        full = [c for e, u, c in cells if (e, u) == (d, t) and c and c.strip()]
        if held and full and sum(any(c in x for x in held) for c in full) > len(full) / 2:
            expected.add((d, t))
    assert {(r["doc_id"], r["table_id"]) for r in found.collect()} == expected and expected


def plain_renames(new, old, least=0.65):
    parent = lambda n: n.rsplit("/", 1)[0] if "/" in n else ""
    out = {}
    for s, sha in sorted(set(new)):
        for t, other in sorted(set(old)):
            pair = tuple(sorted((s, t)))
            if sha == other and s != t and parent(s) == parent(t) and pair not in out and SequenceMatcher(None, s.lower(), t.lower()).ratio() >= least:
                out[pair] = (t, s, sha)
    return sorted(out.values())


def test_renames_equal_all_pairs(spark):
    rng = random.Random(9)
    name = lambda: rng.choice(["", "a/", "a/b/"]) + "".join(rng.choice("abcdÄx") for _ in range(rng.randint(1, 9))) + rng.choice([".pdf", ".PDF", ".txt"])
    new, old = ([(n, rng.choice(["1", "2", "3"])) for n in {name() for _ in range(80)}] for _ in range(2))
    frames = [spark.createDataFrame(x, "filename string, sha256 string") for x in (new, old)]
    for block in (1000, 3):
        found = catalog.renames(*frames, block=block)
        assert sorted((r["old_name"], r["filename"], r["sha"]) for r in found.collect()) == plain_renames(new, old)
    kinds = {r["filename"]: r["change_type"] for r in catalog.snapshot_diff(*frames, catalog.renames(*frames)).collect()}
    renamed = {x for t, s, _ in plain_renames(new, old) for x in (t, s)}
    s, t = dict(new), dict(old)
    assert {n for n, k in kinds.items() if k == "new"} == set(s) - set(t) - renamed and {n for n, k in kinds.items() if k == "deleted"} == set(t) - set(s) - renamed
    assert {n for n, k in kinds.items() if k == "unchanged"} == {n for n in set(s) & set(t) - renamed if s[n] == t[n]}


def test_many_files_of_one_content(spark):
    """Thousands of empty files in one folder, all of other names than before: bounds leave few pairs to compare."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = ["".join(rng.sample(letters, 12)) for _ in range(4000)]
    old = spark.createDataFrame([(f"d/{n}", "0") for n in names[:2000]] + [("d/the same letters", "0")], "filename string, sha256 string")
    new = spark.createDataFrame([(f"d/{n}", "0") for n in names[2000:]] + [("d/the same letter", "0")], "filename string, sha256 string")
    found = {(r["old_name"], r["filename"]) for r in catalog.renames(new, old).collect()}
    assert ("d/the same letters", "d/the same letter") in found and len(found) < 4000
