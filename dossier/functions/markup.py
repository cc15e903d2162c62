"""Text of an HTML page: a tokenizer for markup and all character references."""

from __future__ import annotations

import re
from html import unescape

#: A start tag; a ``>`` inside a quoted value does not end it.  Possessive, so a scan is linear.
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*+)(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
#: Where a script or style ends.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in ("script", "style")}
#: How comments, marked sections, and declarations, instructions and end tags end, by how they begin.
_ENDS = (
    ("<!--", re.compile(r"--\s*+>")), ("<![CDATA[", re.compile(r"\]\s*+\]\s*+>")), ("<![", re.compile(r"\]\s*+>")),
    ("<!", re.compile(">")), ("<?", re.compile(">")), ("</", re.compile(">")),
)


def html_text(page: str) -> str:
    """Text nodes joined by one space, in order, references decoded.

    Bodies of scripts and styles are text as they stand.  What is open at the end
    stays as text, so no tail is lost: the rest of an open tag or script, and the
    ``<`` of an open comment.  A ``<`` that begins no markup is text.
    """
    parts: list[str] = []
    node: list[str] = []
    at, never = 0, set()

    def flush() -> None:
        text = "".join(node)
        node.clear()
        parts.append(unescape(text) if "&" in text else text)

    while (begin := page.find("<", at)) >= 0:
        node.append(page[at:begin])
        at = begin
        tag = _TAG.match(page, begin)
        if tag:
            flush()
            at = tag.end()
            if end := _RAW_END.get(tag[1].lower()):
                closed = end.search(page, at)
                parts.append(page[at:closed.start() if closed else len(page)])
                at = closed.end() if closed else len(page)
            continue
        if page[begin + 1:begin + 2].isalpha() and page[begin + 1].isascii():
            break  # an open tag: no > in all that follows
        for start, end in _ENDS:
            if page.startswith(start, begin):
                closed = None if start in never else end.search(page, begin + len(start))
                if closed:
                    flush()
                    at = closed.end()
                else:
                    never.add(start)
                break
        if at == begin:
            node.append("<")
            at += 1
    node.append(page[at:])
    flush()
    return " ".join(p for p in parts if p)
