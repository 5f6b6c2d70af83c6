"""Text functions as columns; Python only where Spark has no function: Unicode normal forms and HTML."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values that results must agree on.
PAGE_MARK = r'<seite\s+nummer="(\d+)"\s*/>'
TRUNCATED = "\n\n[... Content truncated due to excessive length ...]"
INJECTION_PATTERNS = [
    r"(?U)<\|\w+\|>",
    r"\[/?INST]",
    r"<</?SYS>>",
    r"</?(?:start_of_turn|end_of_turn)>",
    r"(?im)^###\s*(?:System|Assistant|Human|Instruction|Response|User)\s*:",
]
CLEAN_PATTERNS = [
    (r"(?m)^\s*[-_.]{10,}\s*$", ""),
    (r"(?m)^\s*(\|(\s*|[-=]+))+\s*\|?\s*$", ""),
    (r"(?i)<td>\s*</td>", ""),
    (r"(?i)<tr>\s*</tr>", ""),
    (r"(?m)^\s+$", ""),
    (r"\n{3,}", "\n\n"),
]
PAGE_TAG = r'<seite\s+nummer\s*=\s*"\d+"\s*/>'
EMPTY_CELLS, NO_EMPTY_CELLS = r"(?i)(<td>\s*</td>\s*){%d,}", "<!-- Repetitive empty cells removed -->"
EQUAL_CELLS, NO_EQUAL_CELLS = r"(?i)(<td>[^<>]*</td>\s*)\1{%d,}", "<!-- Repetitive cells removed -->"
REPEATED_WORD = r"(?U)(\b\w{3,}\b)(?:\s*\1){%d,}"
UNSAFE_IN_NAMES = r'[<>:"\\|?*\x00-\x1F ]'
UNSAFE_IN_STEMS = r'[<>:"|?*]'
PARAGRAPH_SIGN = r"\$\\S\$"
DEGREE_SIGN = r"\$([^$]*)\^\{[c]irc\}([^$]*)\$"
TABLE_CONTENT = r"(?is)<table_content>\s*(.*?)\s*</table_content>"
TABLE_TAGS = ["<tr", "<td", "<th"]
FIGURE, TABLE = r"(?s)<BILD[^>]*>(.*?)</BILD>", r"(?s)<TABELLE[^>]*>(.*?)</TABELLE>"
NO_CONTENT = "[Content removed due to potential hallucination]"
NO_DESCRIPTION = "[Description removed due to potential hallucination]"
EXTERNAL_MARK = "¤"
EXTERNAL_OPEN, EXTERNAL_CLOSE = "<¤EXTERNAL_DATA¤>", "</¤EXTERNAL_DATA¤>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also where a lambda inside needs it for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 read again; text without such bytes, or no valid UTF-8, stays."""
    narrow = text.rlike(r"[\x{80}-\x{FF}]") & ~text.rlike(r"[^\x{00}-\x{FF}]")
    raw = F.encode(F.when(narrow, text), "ISO-8859-1")
    return F.when(narrow & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def clean_transcription(text: Column) -> Column:
    """Separator lines, empty table rows and cells, blank lines and runs of line ends removed, then stripped."""
    for pattern, new in CLEAN_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def drop_repeated_cells(text: Column, times: int = 10) -> Column:
    """Runs of ``times`` or more empty or equal table cells become a comment."""
    text = F.regexp_replace(text, EMPTY_CELLS % times, NO_EMPTY_CELLS)
    return F.regexp_replace(text, EQUAL_CELLS % (times - 1), NO_EQUAL_CELLS)


def is_loop(text: Column, longest: int = 100_000, times: int = 25) -> Column:
    """Longer than allowed, or one word of three or more letters ``times`` times in a row."""
    repeats = text.rlike(REPEATED_WORD % (times - 1))
    return F.coalesce((F.length(text) > longest) | repeats, F.lit(False))


def truncate(text: Column, longest: int = 10_000) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(TRUNCATED))).otherwise(text)


def normal_german(text: Column) -> Column:
    """Lower case, umlauts and their two-letter spellings as plain vowels."""
    out = F.lower(text)
    for old, new in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss"), ("ae", "a"), ("oe", "o"), ("ue", "u")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def without_numbering(title: Column) -> Column:
    return strip(F.regexp_replace(title, r"^[0-9.\s]+", ""))


def header_level(title: Column) -> Column:
    """Depth of a leading number such as 1.2.3, 1 without one."""
    number = F.regexp_replace(F.regexp_extract(title, r"^([0-9.]+)", 1), r"^\.+|\.+$", "")
    return F.when(number == "", F.lit(1)).otherwise(F.size(F.split(number, r"\."))).cast("int")


def digit_free(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[0-9]+", ""))


def page_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)), lambda x: x.cast("int"))


def table_text(html: Column, longest: int = 500) -> Column:
    """Text of an HTML table on one line, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest), F.lit("..."))).otherwise(flat)


def is_table_fragment(text: Column) -> Column:
    """Begins with an opening row or cell tag, or holds two of them; what only starts like one counts too."""
    opening = "|".join(TABLE_TAGS)
    return strip(text).rlike(f"(?i)^(?:{opening})") | (F.regexp_count(text, F.lit(f"(?i){opening}")) >= 2)


def sanitized(text: Column) -> Column:
    """Invisible characters, data tags and the five kinds of prompt marks removed, one after the other."""
    text = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Cs}&&[^\n\r\t]]", "")
    for mark in (EXTERNAL_OPEN, EXTERNAL_CLOSE, EXTERNAL_MARK):
        text = F.replace(text, F.lit(mark), F.lit(""))
    for pattern in INJECTION_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return text


def middle_cut(text: Column, longest: int, mark: str) -> Column:
    """First half, a mark, last half of what is longer than allowed; the mark counts."""
    half = (longest - len(mark)) // 2
    return F.when(F.length(text) > longest - len(mark), F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def safe_name(name: Column) -> Column:
    """A file name without separators, control characters, spaces at its ends or runs of dots."""
    name = F.regexp_replace(name, UNSAFE_IN_NAMES, "_")
    return F.regexp_replace(F.regexp_replace(name, r"\.{2,}", "."), r"^[ .]+|[ .]+$", "")


def normal_entry_name(name: Column) -> Column:
    """An archive entry's path with forward slashes; null for folders, parent steps and resource forks."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    path = F.array_join(parts, "/")
    bad = name.rlike(r"[/\\]$") | (F.size(parts) == 0) | F.array_contains(parts, "..") | (F.get(parts, F.lit(0)) == "__MACOSX") | path.startswith("._")
    return F.when(~bad, path)


def object_path(kind: Column, project: Column, version: Column, name: Column) -> Column:
    return F.concat_ws("/", kind, project.cast("string"), F.concat(F.lit("v"), version.cast("string")), safe_name(name))


#: Builders of object paths by kind of file; any number may be registered.
PATH_BUILDERS: dict[str, Callable[[Column, Column, Column], Column]] = {}


def register_path(kind: str, builder: Callable[[Column, Column, Column], Column]) -> None:
    """A builder of (project, version, name) for a kind of file; the last one registered counts."""
    PATH_BUILDERS[kind] = builder


def path_by_kind(kind: Column, project: Column, version: Column, name: Column) -> Column:
    """The path that a file's kind has a builder for, else the general one."""
    out = object_path(kind, project, version, name)
    for known, builder in PATH_BUILDERS.items():
        out = F.when(kind == known, builder(project, version, name)).otherwise(out)
    return out


def has_keyword(name: Column, keywords: list[str]) -> Column:
    """Any keyword inside the composed lower-case name, or its base letters inside the name's ASCII characters.

    A damaged name has lost its umlauts' bytes to other signs, so those are dropped; a keyword's umlauts keep
    their base letter.
    """
    lower = composed(F.lower(name))
    plain = F.regexp_replace(lower, r"[^\x00-\x7F]", "")
    out = F.lit(False)
    for k in [unicodedata.normalize("NFC", k.lower()) for k in keywords]:
        letters = unicodedata.normalize("NFD", k).encode("ascii", "ignore").decode()
        out = out | lower.contains(k) | (plain.contains(letters) if letters else F.lit(False))
    return F.coalesce(out, F.lit(False))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode's composed normal form."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def safe_stem(name: Column) -> Column:
    """A composed name without control, format and separator characters; signs that file systems refuse become ``_``."""
    kept = F.regexp_replace(composed(name), r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}&&[^\t]]", "")
    return F.regexp_replace(kept, UNSAFE_IN_STEMS, "_")


def child_text(block: Column, tag: str) -> Column:
    """Trimmed content of the first element of a name, blank without one."""
    return strip(F.regexp_extract(block, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def _blocks_replaced(text: Column, pattern: str, new) -> Column:
    """Each match's first group replaced by what ``new`` makes of it."""
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern, -1)
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(inner, lambda b, i: F.concat(new(b), F.get(gaps, i + 1))), ""))


def _first_filled(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def summaries_only(text: Column) -> Column:
    """Figures and tables replaced by their summaries; a table without one by its text."""
    out = _blocks_replaced(text, FIGURE, lambda b: F.regexp_extract(b, "(?s)<summary>(.*?)</summary>", 1))
    summary = lambda b: F.regexp_extract(b, "(?s)<summary>(.*?)</summary>", 1)
    return _blocks_replaced(out, TABLE, lambda b: F.when(strip(summary(b)) != "", summary(b)).otherwise(table_text(b)))


def labelled_blocks(text: Column) -> Column:
    """Figures and tables replaced by ``[Bild: …]`` and ``[Tabelle: …]`` with the best short text they hold."""

    def shown(name: str, *options: Column) -> Column:
        found = _first_filled(*options)
        return F.when(found == "", f"[{name}]").otherwise(F.concat(F.lit(f"[{name}: "), found, F.lit("]")))

    out = _blocks_replaced(text, FIGURE, lambda b: shown("Bild", *[child_text(b, t) for t in ("summary", "description", "caption_text")]))
    return _blocks_replaced(out, TABLE, lambda b: shown("Tabelle", child_text(b, "summary"), child_text(b, "caption_text"), table_text(b)))


def visual_block(
    kind: Column, image: Column, extraction: Column, description: Column, summary: Column, caption: Column, footnote: Column, bad_extraction: Column, bad_description: Column
) -> Column:
    """The element that replaces a figure or table in markdown; doubtful texts are replaced by a note."""
    clean = lambda t: clean_transcription(fix_mojibake(t))
    body = F.when(bad_extraction, NO_CONTENT).otherwise(clean(extraction))
    said = F.when(bad_description, NO_DESCRIPTION).otherwise(clean(description))
    tag = F.when(F.lower(strip(body)).startswith("<table>") | (kind == "table"), "TABELLE").otherwise("BILD")
    extra = lambda t, x: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n<{t}>"), x, F.lit(f"</{t}>")))
    part = lambda t, x: F.concat(F.lit(f"<{t}>\n"), x, F.lit(f"\n</{t}>"))
    inner = F.concat_ws("\n", part("content", body), part("description", said), part("summary", clean(summary)))
    head = F.concat(F.lit("\n\n<"), tag, F.lit(' img_path="'), image, F.lit('">'), extra("caption_text", caption), F.lit("\n"))
    return F.concat(head, inner, extra("footnote_text", footnote), F.lit("\n</"), tag, F.lit(">"))


def rendered(template: str, **values: Column) -> Column:
    """A template of the caller's own with ``{name}`` fields; values are sanitized first, the data tags are known fields."""
    import string

    known = {k: sanitized(F.coalesce(v.cast("string"), F.lit(""))) for k, v in values.items()}
    known |= {"external_data_tag_open": F.lit(EXTERNAL_OPEN), "external_data_tag_close": F.lit(EXTERNAL_CLOSE)}
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if field is not None:
            parts.append(known[field])
    return F.concat(*parts) if parts else F.lit("")


def upload_type(name: Column, types: dict[str, str]) -> Column:
    """The MIME type of a name's last extension, whatever its case; null for others.  A leading dot begins no extension."""
    extension = F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.try_element_at(known, extension)


#: First bytes of file types that may be uploaded.
MAGIC = [("25504446", "application/pdf"), ("504B0304", "application/zip"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg")]
BYTE_ORDER_MARKS = ["EFBBBF", "FFFE", "FEFF"]


def content_type(content: Column) -> Column:
    """The MIME type that a file's first bytes stand for, null for unknown ones."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def upload_error(name: Column, content: Column, types: dict[str, str], allowed: list[str]) -> Column:
    """Why a file may not be uploaded: extension, type, script or content; null for one that may.  Null content is not looked at."""
    head = F.hex(F.substring(content, 1, 8))
    script = head.startswith(F.hex(F.lit("#!")))
    for mark in BYTE_ORDER_MARKS:
        script = script | head.startswith(F.concat(F.lit(mark), F.hex(F.lit("#!"))))
    found = content_type(content)
    kind = upload_type(name, types)
    bad = F.when(kind.isNull(), "extension").when(~kind.isin(allowed), "type").when(F.coalesce(script, F.lit(False)), "script")
    return bad.when(content.isNotNull() & ~F.coalesce(found.isin(allowed), F.lit(False)), "content")


def triage(name: Column, *, skipped: list[str], extensions: list[str], priority: list[str]) -> Column:
    """What becomes of a document by its name: skipped, unsupported, priority or regular."""
    extension = F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))
    return (
        F.when(has_keyword(name, skipped), "skipped").when(~extension.isin(extensions), "unsupported").when(has_keyword(name, priority), "priority").otherwise("regular")
    )


def n_tokens(text: Column) -> Column:
    """White-space tokens; the default counter where no tokenizer is plugged in."""
    flat = strip(text)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(flat, r"\s+"))).cast("long")


def statement_kind(query: Column) -> Column:
    head = F.upper(F.ltrim(query))
    out = F.lit("OTHER")
    for word in ("CREATE", "DELETE", "UPDATE", "INSERT"):
        out = F.when(head.startswith(word), F.lit(word)).otherwise(out)
    return F.when(query.isNull(), F.lit(None).cast("string")).otherwise(out)


def chunk_text(kind: Column, content: Column, summary: Column, begin: str = "[SUMMARY]", end: str = "[/SUMMARY]") -> Column:
    """Text chunks verbatim; others their summary between marks, blank without one."""
    s = strip(F.coalesce(summary, F.lit("")))
    return F.when(kind == "text", strip(content)).when(s == "", F.lit("")).otherwise(F.concat(F.lit(begin + "\n"), s, F.lit("\n" + end)))


def plain_symbols(text: Column) -> Column:
    """Paragraph and degree signs written as formulas become characters."""
    return F.regexp_replace(F.regexp_replace(text, PARAGRAPH_SIGN, "§"), DEGREE_SIGN, "$1°$2")


def wrapped(text: Column) -> Column:
    """Sanitized text between data tags, which no sanitized text can hold."""
    return F.concat(F.lit(EXTERNAL_OPEN + "\n"), sanitized(text), F.lit("\n" + EXTERNAL_CLOSE))


def table_content(text: Column) -> Column:
    """What stands inside the first table_content element, else the whole text."""
    found = text.contains("<table_content>") & text.rlike(TABLE_CONTENT)
    return F.when(found, strip(F.regexp_extract(text, TABLE_CONTENT, 1))).otherwise(text)


def output_folder(name: Column) -> Column:
    """A file's path without its extension."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def mapped_keys(context: Column, names: dict[str, str]) -> Column:
    """A map with its keys renamed by ``names``; other keys stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(context, lambda k, _: F.coalesce(F.try_element_at(pairs, k), k))
