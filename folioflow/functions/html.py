"""HTML as a lenient reader sees it: a tree of elements, written again in one form.

Nothing is inferred: an element stays open until its end mark, or that of one around it, is met.  Names are in lower
case, a repeated attribute has its last value, a text of nothing but ASCII blanks is one line end or one space (not in
``pre`` and ``textarea``), entities are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, texts that are written as they are, blanks that are kept, attributes of several words.
VOID_TAGS = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
RAW_TAGS = {"script", "style"}
KEEPS_BLANKS = {"pre", "textarea"}
OWN_TEXT = {"script", "style", "template"}
BLANKS = " \n\t\f\r"
LISTS = {"*": {"class", "accesskey", "dropzone"}, "a": {"rel", "rev"}, "link": {"rel", "rev"}, "td": {"headers"}, "th": {"headers"}, "form": {"accept-charset"}, "object": {"archive"}, "area": {"rel"}, "icon": {"sizes"}, "iframe": {"sandbox"}, "output": {"for"}}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Mark(str):
    """A comment, declaration or instruction, as it is written."""


class Element:
    def __init__(self, name: str, attributes: list[tuple[str, str | None]] = ()):
        self.name, self.attributes, self.inside = name, {k: v or "" for k, v in attributes}, []
        for k, v in self.attributes.items():
            if k in LISTS["*"] or k in LISTS.get(name, ()):
                self.attributes[k] = " ".join(v.split())

    def below(self) -> Iterator[Element]:
        """All elements below, depth first."""
        stack = [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Element):
                    yield x
                    stack.append(iter(x.inside))
                    break
            else:
                stack.pop()

    def first(self, name: str) -> Element | None:
        return next((e for e in self.below() if e.name == name), None)

    def child(self, name: str) -> Element | None:
        return next((e for e in self.inside if isinstance(e, Element) and e.name == name), None)

    def text(self) -> str:
        """The texts below, without marks and scripts."""
        parts = [x for x in self.inside if type(x) is str] if self.name not in OWN_TEXT else []
        if not any(isinstance(x, Element) for x in self.inside):
            return "".join(parts)
        return "".join(self._texts())

    def _texts(self) -> Iterator[str]:
        stack = [(self, iter(self.inside))]
        while stack:
            owner, rest = stack[-1]
            for x in rest:
                if isinstance(x, Element):
                    stack.append((x, iter(x.inside)))
                    break
                if type(x) is str and owner.name not in OWN_TEXT:
                    yield x
            else:
                stack.pop()

    def opening(self) -> str:
        shown = []
        for k, v in self.attributes.items():
            v = _escaped(v)
            if '"' not in v:
                shown.append(f' {k}="{v}"')
            elif "'" not in v:
                shown.append(f" {k}='{v}'")
            else:
                shown.append(f' {k}="{v.replace(chr(34), "&quot;")}"')
        return f"<{self.name}{''.join(shown)}{'/' if self.name in VOID_TAGS else ''}>"

    def inner(self) -> str:
        out: list[str] = []
        stack = [(self, iter(self.inside))]
        while stack:
            owner, rest = stack[-1]
            for x in rest:
                if isinstance(x, Element):
                    out.append(x.opening())
                    stack.append((x, iter(x.inside)))
                    break
                out.append(x if isinstance(x, Mark) or owner.name in RAW_TAGS else _escaped(x))
            else:
                stack.pop()
                if stack and owner.name not in VOID_TAGS:
                    out.append(f"</{owner.name}>")
        return "".join(out)

    def __str__(self) -> str:
        return self.opening() + ("" if self.name in VOID_TAGS else f"{self.inner()}</{self.name}>")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open = [Element("")]
        self.held: list[str] = []
        self.closed_void: list[str] = []

    def finish(self) -> None:
        """The text so far becomes a child."""
        text = "".join(self.held)
        self.held = []
        if text and not text.strip(BLANKS) and not any(e.name in KEEPS_BLANKS for e in self.open):
            text = "\n" if "\n" in text else " "
        if text:
            self.open[-1].inside.append(text)

    def mark(self, text: str) -> None:
        self.finish()
        self.open[-1].inside.append(Mark(text))

    def begin(self, tag: str, attrs: list[tuple[str, str | None]]) -> Element:
        self.finish()
        element = Element(tag, attrs)
        self.open[-1].inside.append(element)
        self.open.append(element)
        return element

    def end(self, tag: str) -> None:
        self.finish()
        if any(e.name == tag for e in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_starttag(self, tag, attrs):
        self.begin(tag, attrs)
        if tag in VOID_TAGS:
            self.end(tag)
            self.closed_void.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.begin(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.closed_void:
            # an end mark for an element that has none
            self.closed_void.remove(tag)
            if self.open[-1].name == tag:
                self.end(tag)
        else:
            self.end(tag)

    def handle_data(self, data):
        self.held.append(data)

    def handle_charref(self, name):
        number = int(name[1:], 16) if name[:1] in "xX" else int(name)
        try:
            # numbers below 256 often mean the Windows code page
            self.held.append(bytes([number]).decode("windows-1252") if number < 256 else chr(number))
        except UnicodeDecodeError:
            self.held.append(chr(number))
        except (ValueError, OverflowError):
            self.held.append("\N{REPLACEMENT CHARACTER}")

    def handle_entityref(self, name):
        self.held.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self.mark(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.mark(f"<!DOCTYPE {decl[len('DOCTYPE ') :]}>\n")

    def unknown_decl(self, data):
        self.mark(f"<![CDATA[{data[6:]}]]>" if data.upper().startswith("CDATA[") else f"<!{data}>")

    def handle_pi(self, data):
        self.mark(f"<?{data}>")


def parsed(html: str) -> Element:
    """The tree of a text; the root has no name."""
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # a declaration that the standard reader gives up on: what was read so far stands
        pass
    reader.finish()
    return reader.open[0]


@F.pandas_udf(T.StringType())
def canonical_html(html: pd.Series) -> pd.Series:
    """HTML read and written again, so that equal tables compare equal; null is empty."""
    return html.map(lambda text: parsed(text or "").inner())
