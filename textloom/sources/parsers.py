"""Parsers of single values: HTML, Markdown blocks, XML, forms, archives, encodings.

None of them throws on text that is merely odd; what is not there comes back as
null or as an empty list.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

#: Elements that never have content (fixed by the HTML standard).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose end separates lines of text.
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
HIDDEN = {"script", "style", "head", "title", "template", "noscript"}


class _Tree(HTMLParser):
    """Rows (id, parent, ordinal, kind, name, text, attributes) in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int | None, int] = {}

    def add(self, kind: str, name: str | None, text: str | None, attrs: dict | None) -> int:
        parent = self.open[-1] if self.open else None
        k = self.children.get(parent, 0)
        self.children[parent] = k + 1
        self.rows.append({"node_id": len(self.rows), "parent_id": parent, "ordinal": k, "kind": kind, "name": name, "text": text, "attrs": attrs})
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        # an open paragraph or list item ends where a new one or a block begins
        for auto in ("p", "li"):
            if self.open and self.rows[self.open[-1]]["name"] == auto and (tag == auto or auto == "p" and tag in BLOCK):
                self.open.pop()
        i = self.add("element", tag, None, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.add("element", tag, None, {k: v or "" for k, v in reversed(attrs)})

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]]["name"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.add("text", None, data, None)

    def handle_comment(self, data):
        self.add("comment", None, data, None)


def html_nodes(html: str | None) -> list[dict]:
    """The tree of a page as rows."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.rows


def _ancestors(rows: list[dict], i: int | None):
    while i is not None:
        yield rows[i]
        i = rows[i]["parent_id"]


def html_text(html: str | None) -> str:
    """Visible text: white space collapsed, blocks on lines of their own."""
    rows = html_nodes(html)
    out: list[str] = []
    for r in rows:
        if r["kind"] == "element" and (r["name"] in BLOCK or r["name"] == "br"):
            out.append("\n")
        elif r["kind"] == "text" and not any(a["name"] in HIDDEN for a in _ancestors(rows, r["parent_id"])):
            out.append(re.sub(r"\s+", " ", r["text"]))
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x)


def html_links(html: str | None) -> list[tuple[str, str]]:
    """(target, text) of links with a target."""
    rows = html_nodes(html)
    out = []
    for r in rows:
        if r["kind"] == "element" and r["name"] == "a" and "href" in r["attrs"]:
            inside = [x["text"] for x in rows[r["node_id"] :] if x["kind"] == "text" and any(a is r for a in _ancestors(rows, x["parent_id"]))]
            out.append((r["attrs"]["href"], re.sub(r"\s+", " ", "".join(inside)).strip()))
    return out


def language_of(rows: list[dict], node_id: int) -> str | None:
    """The language in scope at a node: the nearest ``lang``; a blank one means unknown."""
    for r in _ancestors(rows, node_id):
        if r["attrs"] and "lang" in r["attrs"]:
            return r["attrs"]["lang"].strip() or None
    return None


def rich_text_to_plain(text: str | None) -> str | None:
    """XHTML rich text as plain text; null if it does not parse."""
    try:
        root = ET.fromstring(f"<x>{text or ''}</x>")
    except ET.ParseError:
        return None
    blocks = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "body"}
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = e.tag.rsplit("}", 1)[-1].lower()
        if name in blocks:
            out.append("\n")
        out.append(re.sub(r"\s+", " ", e.text or ""))
        for c in e:
            walk(c)
            out.append(re.sub(r"\s+", " ", c.tail or ""))
        if name in blocks:
            out.append("\n")

    walk(root)
    return re.sub(r"[ \n]*\n[ \n]*", "\n", re.sub(r" +", " ", "".join(out))).strip()


# --- Markdown -----------------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?: +|$)(.*)$")


def markdown_blocks(text: str | None) -> list[dict]:
    """Blocks of a document: {ordinal, kind, level, text}; kinds: heading, code, quote, item, rule, table, paragraph."""
    lines = (text or "").split("\n")
    out: list[dict] = []
    i = 0

    def add(kind: str, level: int, body: str) -> None:
        out.append({"ordinal": len(out), "kind": kind, "level": level, "text": body})

    def opens(line: str) -> bool:
        return bool(re.match(r"^ {0,3}(#{1,6}(\s|$)|>|(`{3,}|~{3,})|([-*_])[ \t]*(\4[ \t]*){2,}$)", line) or _ITEM.match(line))

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not re.match(r"^ {0,3}%s{%d,}\s*$" % (re.escape(m[1][0]), len(m[1])), lines[j]):
                j += 1
            add("code", 0, "\n".join(lines[i + 1 : j]))
            i = j + 1
        elif m := re.match(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            add("heading", len(m[1]), m[2] or "")
            i += 1
        elif re.match(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$", line):
            add("rule", 0, "")
            i += 1
        elif re.match(r"^ {0,3}>", line):
            j = i
            while j < len(lines) and (re.match(r"^ {0,3}>", lines[j]) or (lines[j].strip() and not opens(lines[j]))):
                j += 1
            add("quote", 0, "\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]))
            i = j
        elif m := _ITEM.match(line):
            j = i + 1
            while j < len(lines) and lines[j].strip() and not opens(lines[j]):
                j += 1
            add("item", len(m[1]), "\n".join([m[3], *(x.strip() for x in lines[i + 1 : j])]))
            i = j
        elif i + 1 < len(lines) and "|" in line and re.match(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", lines[i + 1]) and "-" in lines[i + 1]:
            j = i + 2
            while j < len(lines) and lines[j].strip() and not opens(lines[j]):
                j += 1
            add("table", 0, "\n".join(lines[i:j]))
            i = j
        else:
            j = i + 1
            level = 0
            while j < len(lines) and lines[j].strip() and not opens(lines[j]):
                if m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                j += 1
            add("heading" if level else "paragraph", level, "\n".join(x.strip() for x in lines[i:j]))
            i = j + 1 if level else j
    return out


# --- XML, forms, archives ----------------------------------------------------------------------------


def xml_leaves(text: str | bytes | None) -> list[tuple[str, str]]:
    """(path, value) of leaf elements, with numbers for repeated names; empty if the text is no XML."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out: list[tuple[str, str]] = []

    def walk(e: ET.Element, path: str) -> None:
        seen: dict[str, int] = {}
        kids = list(e)
        if not kids:
            out.append((path, (e.text or "").strip()))
        for c in kids:
            name = c.tag.rsplit("}", 1)[-1]
            k = seen.get(name, 0)
            seen[name] = k + 1
            walk(c, f"{path}.{name}[{k}]")

    walk(root, root.tag.rsplit("}", 1)[-1])
    return out


def read_xfdf(text: str | None) -> list[tuple[str, str]]:
    """(name, value) of form fields; nested names are joined by dots; the root must be ``xfdf``."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    if plain(root) != "xfdf":
        raise ValueError("not an XFDF document")
    out: list[tuple[str, str]] = []

    def walk(e: ET.Element, path: list[str]) -> None:
        for c in e:
            if plain(c) == "field":
                walk(c, [*path, c.get("name", "")])
            elif plain(c) == "fields":
                walk(c, path)
            elif plain(c) == "value":
                out.append((".".join(path), c.text or ""))

    walk(root, [])
    return out


def write_xfdf(fields: list[tuple[str, str]]) -> str:
    """Form fields as XFDF, dotted names nested."""
    root = ET.Element("xfdf", {"xmlns": "http://ns.adobe.com/xfdf/"})
    top = ET.SubElement(root, "fields")
    for name, value in fields:
        at = top
        for part in name.split("."):
            held = next((c for c in at if c.tag == "field" and c.get("name") == part), None)
            at = ET.SubElement(at, "field", {"name": part}) if held is None else held
        ET.SubElement(at, "value").text = value
    return ET.tostring(root, encoding="unicode")


def zip_entries(data: bytes | None) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's files; names that differ only in case are a ValueError."""
    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("two entries of one name")
        return [(n, z.read(n)) for n in names]


def docx_paragraphs(data: bytes | None) -> list[str]:
    """Texts of a word-processing document's paragraphs."""
    parts = dict(zip_entries(data))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(parts["word/document.xml"])
    return ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]


_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def sniff_charset(data: bytes, label: str | None = None) -> str:
    """Byte order mark, else the given label, else the page's own, else utf-8."""
    import codecs

    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(bom):
            return name
    found = _META.search(data[:1024])
    for name in (label, found and found[1].decode()):
        if name:
            try:
                name = codecs.lookup(name.strip()).name
            except LookupError:
                continue
            if name.startswith("utf-16") and not label:
                return "utf-8"
            return "cp1252" if name in ("ascii", "iso8859-1") else name
    return "utf-8"


def decode_html(data: bytes | None, label: str | None = None) -> str:
    """Bytes as text, bad sequences replaced."""
    data = data or b""
    return data.decode(sniff_charset(data, label), "replace").removeprefix("﻿")
