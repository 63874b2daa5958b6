"""HTML pages to text: a tokenizer with the states of the HTML standard.

Attribute values may hold ``>``; a quote opens a value only after ``=``.  Script and
style hold no text, title and textarea no tags, and a few elements neither tags nor
references.  References need no semicolon where the standard allows it, and numbers
128 to 159 mean Windows-1252 characters, as in browsers.  Time is linear in the page.

The tokenizer is the body of an Arrow UDF; only texts that hold ``<`` or ``&`` are sent
to it (:func:`html_text`).
"""

from __future__ import annotations

import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
NO_TEXT = frozenset(("script", "style"))
NO_TAGS = frozenset(("title", "textarea"))  # references count
RAW = frozenset(("xmp", "iframe", "noembed", "noframes"))  # neither tags nor references

_NAME = re.compile(r"[^\t\n\f\r />]*")
_SKIP = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_VALUE = re.compile(r"[^\t\n\f\r >]*")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*;?))")
_LONGEST = max(map(len, html5))


def _character(code: int) -> str:
    """The character of a numeric reference; U+FFFD for what is no character."""
    if 128 <= code < 160:
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:  # five numbers have no Windows character
            return chr(code)
    if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return "�"
    return chr(code)


def _reference(m: re.Match) -> str:
    dec, hx, name = m.groups()
    if name is None:
        digits = (dec or hx).lstrip("0")
        return "�" if len(digits) > 7 else _character(int(digits or "0", 10 if dec else 16))
    if name in html5:
        return html5[name]
    for end in range(min(len(name), _LONGEST) - 1, 1, -1):  # the longest name that may stand without a semicolon
        if name[:end] in html5:
            return html5[name[:end]] + name[end:]
    return m.group()


def unescape(text: str) -> str:
    """All character references of a text, decoded once."""
    return _REFERENCE.sub(_reference, text) if "&" in text else text


def tag_end(page: str, at: int, attributes: list | None = None) -> int:
    """The place after the ``>`` of a tag whose name ends at ``at``; -1 if the page ends first.

    ``attributes`` gets the (name, value) pairs, names in lower case, values as they stand.
    """
    n = len(page)
    while True:
        at = _SKIP.match(page, at).end()
        if at >= n:
            return -1
        if page[at] == ">":
            return at + 1
        begin, at = at, _ATTRIBUTE.match(page, at).end()
        name = page[begin:at].lower() if attributes is not None else ""
        value = _EQUALS.match(page, at)
        if value is None:
            if attributes is not None:
                attributes.append((name, ""))
            continue
        begin = at = value.end()
        quote = page[at:at + 1]
        if quote and quote in "\"'":
            begin += 1
            at = page.find(quote, begin) + 1
            if not at:
                return -1
        else:
            at = _VALUE.match(page, at).end()
        if attributes is not None:
            attributes.append((name, page[begin:at - 1 if quote and quote in "\"'" else at]))


def _after(page: str, what: str, at: int) -> int:
    found = page.find(what, at)
    return len(page) if found < 0 else found + len(what)


def text_of(page: str) -> str:
    """The text of a page: text nodes with a blank for every tag, comment and block without text.

    What an unfinished tag, comment or block holds is no text; content of templates
    is none either.  ``<`` before anything that cannot begin markup is text.
    """
    out: list[str] = []
    at, n, templates = 0, len(page), 0

    def put(text: str):
        if not templates:
            out.append(text)

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            put(unescape(page[at:]))
            break
        if begin > at:
            put(unescape(page[at:begin]))
        kind = page[begin + 1:begin + 2]
        if kind in LETTERS and kind:
            end = _NAME.match(page, begin + 1).end()
            name = page[begin + 1:end].lower()
            at = tag_end(page, end)
            if at < 0:
                break
            put(" ")
            if name == "template":
                templates += 1
            elif name == "plaintext":
                put(page[at:])
                break
            elif name in NO_TEXT or name in NO_TAGS or name in RAW:
                close = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.IGNORECASE).search(page, at)
                end = close.start() if close else n
                if name in NO_TAGS:
                    put(unescape(page[at:end]))
                elif name in RAW:
                    put(page[at:end])
                at = end
        elif kind == "/" and page[begin + 2:begin + 3] in LETTERS and begin + 2 < n:
            end = _NAME.match(page, begin + 2).end()
            at = tag_end(page, end)
            if at < 0:
                break
            if page[begin + 2:end].lower() == "template":
                templates = max(0, templates - 1)
            put(" ")
        elif kind == "/" and begin + 2 < n:
            if page[begin + 2] == ">":  # </> is nothing at all
                at = begin + 3
            else:
                at = _after(page, ">", begin + 2)
                put(" ")
        elif page.startswith("<!--", begin):
            if page.startswith(">", begin + 4):
                at = begin + 5
            elif page.startswith("->", begin + 4):
                at = begin + 6
            else:
                end = _COMMENT_END.search(page, begin + 4)
                at = end.end() if end else n
            put(" ")
        elif kind and kind in "!?":  # doctypes, instructions and other bogus comments
            at = _after(page, ">", begin + 2)
            put(" ")
        else:
            put("<")
            at = begin + 1
    return "".join(out)


def _texts(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else text_of(p) for p in pages.to_pylist()], pa.string())


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unescape(t) for t in texts.to_pylist()], pa.string())


def unescaped(col: Column) -> Column:
    """All character references of a text column, decoded once."""
    run = F.arrow_udf(_unescaped, "string")
    return F.coalesce(run(F.when(F.instr(col, "&") > 0, col)), col)


def html_text(col: Column) -> Column:
    """The text of an HTML column; texts without ``<`` and ``&`` stay in the JVM."""
    run = F.arrow_udf(_texts, "string")
    marked = (F.instr(col, "<") > 0) | (F.instr(col, "&") > 0)
    return F.coalesce(run(F.when(marked, col)), col)
