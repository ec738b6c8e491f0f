"""Inline Markdown of one leaf block, as rows in reading order.

The text is cut into pieces once, left to right. Emphasis and links don't move
pieces about: what they find are marks on pieces (so many spans open before it, so
many close after it), and the last pass turns marks into depths. Delimiters form a
list linked both ways; for each kind of closer the place is remembered below which no
opener is, so that each is visited a bounded number of times. A link's target may hold
32 nested brackets at most, and ends that a text doesn't have are looked for once; so
the whole is linear in the text.
"""

from __future__ import annotations

import html
import re
import unicodedata

MOST_BRACKETS = 1000
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = re.compile(r"[^\\`*_\[\]!<&\n]+")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ADDRESS = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>", re.ASCII)
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*+(?:\s*=\s*(?:[^\s\"'=<>`]++|'[^']*'|\"[^\"]*\"))?+"
_TAG = re.compile(rf"<(?:[A-Za-z][A-Za-z0-9-]*+(?:{_ATTRIBUTE})*+\s*/?>|/[A-Za-z][A-Za-z0-9-]*\s*>)", re.ASCII)
_TITLE = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)", re.DOTALL)


def unescaped(s: str) -> str:
    """Backslash escapes and character references as what they stand for."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|" + _ENTITY.pattern, lambda m: m[1] or html.unescape(m[0]), s)


def label(s: str) -> str:
    """The key of a reference label: white space collapsed, case folded."""
    return re.sub(r"\s+", " ", s.strip()).casefold()


def _punctuation(c: str) -> bool:
    return c in PUNCTUATION or unicodedata.category(c)[0] in "PS"


class _Piece:
    __slots__ = ("kind", "text", "target", "opens", "closes", "before", "after", "left", "size", "opener", "closer", "alive")

    def __init__(self, kind: str, text: str, target: str | None = None) -> None:
        self.kind, self.text, self.target = kind, text, target
        self.opens: list[tuple[str, str | None]] = []  # inmost first
        self.closes = 0  # spans that end before what is left of the piece
        self.alive = False


class _Leaf:
    def __init__(self, text: str, refs: dict[str, str]) -> None:
        self.s, self.refs, self.at = text, refs, 0
        self.pieces: list[_Piece] = []
        self.head = _Piece("head", "")  # sentinel of the delimiter list
        self.head.before = self.head.after = None
        self.tail = self.head
        self.brackets: list[tuple[int, bool, _Piece, int]] = []
        self.closed = 0  # links below this height of the stack may not hold links
        self.ticks: dict[int, list[int]] = {}
        for m in reversed(list(re.finditer(r"`+", text))):
            self.ticks.setdefault(len(m[0]), []).append(m.start())
        self.gone: set[str] = set()

    def add(self, kind: str, text: str, target: str | None = None) -> _Piece:
        self.pieces.append(_Piece(kind, text, target))
        return self.pieces[-1]

    def run(self) -> list[_Piece]:
        s, n = self.s, len(self.s)
        while self.at < n:
            if m := _PLAIN.match(s, self.at):
                self.add("text", m[0])
                self.at = m.end()
                continue
            {"\\": self.backslash, "`": self.code, "*": self.delimiter, "_": self.delimiter, "[": self.bracket, "!": self.bracket, "]": self.end, "<": self.angle, "&": self.entity, "\n": self.line}[s[self.at]]()
        self.emphasis(self.head)
        return self.pieces

    def backslash(self) -> None:
        c = self.s[self.at + 1 : self.at + 2]
        if c == "\n":
            self.add("hardbreak", "")
            self.at += 2
            self.indent()
        else:
            escaped = c in PUNCTUATION and c != ""
            self.add("text", c if escaped else "\\")
            self.at += 2 if escaped else 1

    def indent(self) -> None:
        while self.s[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1

    def line(self) -> None:
        last = self.pieces[-1] if self.pieces else None
        hard = False
        if last is not None and last.kind == "text":
            hard = last.text.endswith("  ")
            last.text = last.text.rstrip(" ")
        self.add("hardbreak" if hard else "softbreak", "")
        self.at += 1
        self.indent()

    def code(self) -> None:
        n = len(re.compile("`+").match(self.s, self.at)[0])
        places = self.ticks[n]
        while places and places[-1] <= self.at:
            places.pop()
        if not places:
            self.add("text", "`" * n)
            self.at += n
            return
        inner = self.s[self.at + n : places[-1]].replace("\n", " ")
        if len(inner) > 1 and inner[0] == inner[-1] == " " and inner.strip(" "):
            inner = inner[1:-1]
        self.add("code", inner)
        self.at = places[-1] + n

    def entity(self) -> None:
        m = _ENTITY.match(self.s, self.at)
        known = m is not None and (m[0][1] == "#" or m[0][1:] in html.entities.html5)
        self.add("text", html.unescape(m[0]) if known else "&")
        self.at = m.end() if known else self.at + 1

    def angle(self) -> None:
        s, at = self.s, self.at
        if m := _ADDRESS.match(s, at):
            self.add("autolink", m[1], m[1])
        elif m := _MAIL.match(s, at):
            self.add("autolink", m[1], "mailto:" + m[1])
        elif m := _TAG.match(s, at):
            self.add("html", m[0])
        else:
            end = self.until(at)
            self.add("html" if end else "text", s[at:end] if end else "<")
            self.at = end or at + 1
            return
        self.at = m.end()

    def until(self, at: int) -> int | None:
        """The end of a comment, an instruction, a declaration or a data section."""
        s = self.s
        for short in ("<!-->", "<!--->"):
            if s.startswith(short, at):
                return at + len(short)
        for mark, end in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">")):
            if s.startswith(mark, at):
                if end in self.gone or mark == "<!" and not s[at + 2 : at + 3].isalpha():
                    return None
                found = s.find(end, at + len(mark))
                if found < 0:
                    self.gone.add(end)
                    return None
                return found + len(end)
        return None

    def delimiter(self) -> None:
        s, at = self.s, self.at
        c, end = s[at], at
        while end < len(s) and s[end] == c:
            end += 1
        left, right = s[at - 1] if at else "\n", s[end] if end < len(s) else "\n"
        white_left, white_right = left.isspace(), right.isspace()
        mark_left, mark_right = _punctuation(left), _punctuation(right)
        opens = not white_right and (not mark_right or white_left or mark_left)
        closes = not white_left and (not mark_left or white_right or mark_right)
        d = self.add("text", "")
        d.text = s[at:end]
        d.size = d.left = end - at
        d.opener = opens and (c == "*" or not closes or mark_left)
        d.closer = closes and (c == "*" or not opens or mark_right)
        d.alive, d.before, d.after = True, self.tail, None
        self.tail.after = self.tail = d
        self.at = end

    def drop(self, d: _Piece) -> None:
        d.alive = False
        d.before.after = d.after
        if d.after is not None:
            d.after.before = d.before
        else:
            self.tail = d.before

    def emphasis(self, bottom: _Piece) -> None:
        """Pair the delimiters after ``bottom``, then forget them."""
        lowest: dict[tuple, _Piece] = {}
        closer = bottom.after
        while closer is not None:
            following = closer.after
            if not closer.closer:
                closer = following
                continue
            key = (closer.text[0], closer.opener, closer.size % 3)
            stop = lowest.get(key, bottom)
            opener = closer.before
            while opener is not bottom and opener is not stop:
                both = (opener.closer or closer.opener) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
                if opener.opener and opener.text[0] == closer.text[0] and not both:
                    break
                opener = opener.before
            else:
                lowest[key] = closer.before
                if not closer.opener:
                    self.drop(closer)
                closer = following
                continue
            while opener.after is not closer:
                self.drop(opener.after)
            used = 2 if opener.left >= 2 and closer.left >= 2 else 1
            opener.opens.append(("strong" if used == 2 else "emph", None))
            closer.closes += 1
            opener.left -= used
            closer.left -= used
            for d in (opener, closer):
                if not d.left:
                    self.drop(d)
            if not closer.left:
                closer = following
        while bottom.after is not None:
            self.drop(bottom.after)

    def bracket(self) -> None:
        image = self.s[self.at] == "!"
        if image and self.s[self.at + 1 : self.at + 2] != "[":
            self.add("text", "!")
            self.at += 1
            return
        self.at += 1 + image
        self.add("text", "![" if image else "[")
        if len(self.brackets) < MOST_BRACKETS:
            self.brackets.append((len(self.pieces) - 1, image, self.tail, self.at))

    def end(self) -> None:
        s, at = self.s, self.at
        self.at += 1
        if not self.brackets:
            self.add("text", "]")
            return
        height = len(self.brackets) - 1
        piece, image, bottom, start = self.brackets.pop()
        inside = image or height >= self.closed
        self.closed = min(self.closed, height)
        found = (self.inline(at + 1) or self.reference(start, at)) if inside else None
        if found is None:
            self.add("text", "]")
            return
        target, self.at = found
        opener = self.pieces[piece]
        opener.text = ""
        opener.opens.append(("image" if image else "link", target))
        self.emphasis(bottom)
        self.add("text", "").closes = 1
        if not image:
            self.closed = len(self.brackets)

    def inline(self, at: int) -> tuple[str, int] | None:
        """Target and end of ``(target "title")``."""
        s = self.s
        if s[at : at + 1] != "(":
            return None
        at = _blank(s, at + 1)
        if s[at : at + 1] == "<":
            m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(s, at)
            if not m:
                return None
            target, at = m[1], m.end()
        else:
            first, deep = at, 0
            while at < len(s) and s[at] > " " and s[at] != "\x7f":
                if s[at] == "\\" and s[at + 1 : at + 2] in PUNCTUATION and at + 1 < len(s):
                    at += 1
                elif s[at] == "(":
                    deep += 1
                    if deep > 32:
                        return None
                elif s[at] == ")":
                    if not deep:
                        break
                    deep -= 1
                at += 1
            if deep:
                return None
            target = s[first:at]
        title = _blank(s, at)
        if title > at and s[title : title + 1] in ('"', "'", "("):
            mark = {"(": ")"}.get(s[title], s[title])
            if "title" + mark in self.gone:
                return None
            m = _TITLE.match(s, title)
            if not m:
                if mark != ")":  # no such mark is left in the text
                    self.gone.add("title" + mark)
                return None
            title = _blank(s, m.end())
        return (unescaped(target), title + 1) if s[title : title + 1] == ")" else None

    def reference(self, start: int, at: int) -> tuple[str, int] | None:
        """Target and end of ``[text][label]``, ``[label][]`` or ``[label]``."""
        if not self.refs:
            return None
        m = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.DOTALL).match(self.s, at + 1)
        said = m[1] if m and m[1].strip() else self.s[start:at] if at - start <= 999 else ""
        target = self.refs.get(label(said)) if said.strip() else None
        return None if target is None else (target, m.end() if m else at + 1)


def _blank(s: str, at: int) -> int:
    while at < len(s) and s[at] in " \t\n":
        at += 1
    return at


def inlines(text: str | None, refs: dict[str, str] | None = None) -> list[tuple[int, int, str, str, str | None]]:
    """Rows (ordinal, depth, kind, text, target) in reading order; a span (emph, strong, link, image) stands before what it holds, one deeper.

    Kinds: text, code, html, autolink, softbreak, hardbreak, and the spans. ``refs``:
    targets by ``label``. Neighbouring texts are one. Null or blank text gives nothing.
    """
    out: list[list] = []
    depth = 0
    for p in _Leaf((text or "").strip(" \t\n"), refs or {}).run():
        depth -= p.closes
        delimiter = hasattr(p, "left")
        said = p.text[: p.left] if delimiter else p.text
        if p.kind != "text" or said:
            if p.kind == "text" and out and out[-1][1:3] == [depth, "text"] and not p.closes:
                out[-1][3] += said
            else:
                out.append([len(out), depth, p.kind, said, p.target])
        for kind, target in reversed(p.opens):
            out.append([len(out), depth, kind, "", target])
            depth += 1
    return [tuple(r) for r in out]
