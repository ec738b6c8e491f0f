"""Functions of single values: references, templates, calls, roles, metadata packets, selectors, pictures."""

from __future__ import annotations

import html
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np

# --- text ------------------------------------------------------------------------------------

_XML = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape_xml(text: str) -> str:
    """The five named references and numeric ones; all else stays as it is."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _XML:
            return _XML[name]
        if name[0] == "#":
            n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
        return m[0]

    return re.sub(r"&(#[xX][0-9A-Fa-f]+|#\d+|[A-Za-z]+);", one, text)


def resolve_char_refs(text: str, attribute: bool = False) -> str:
    """HTML character references; in an attribute a name without its semicolon stays before = or a letter or digit."""
    if not attribute:
        return html.unescape(text)
    return re.sub(r"&(?:#[xX]?[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)(;?)(?![=A-Za-z0-9])|&[^;&\s]+;", lambda m: html.unescape(m[0]), text)


def expand_tabs(line: str, stop: int = 8) -> str:
    """Tabs as no-break spaces up to the next stop; columns start anew after a line end."""
    out, column = [], 0
    for c in line:
        n = stop - column % stop if c == "\t" else 1
        out.append(" " * n if c == "\t" else c)
        column = 0 if c == "\n" else column + n
    return "".join(out)


def resolve_template(template: str, values: dict[str, str]) -> str:
    """``{token}`` as its value, unknown ones as nothing; ``{{`` is a brace."""
    return re.sub(r"\{\{|\{([^{}]*)\}", lambda m: "{" if m[0] == "{{" else str(values.get(m[1], "")), template)


def unknown_tokens(template: str, known: set[str]) -> list[str]:
    return sorted({m[1] for m in re.finditer(r"\{\{|\{([^{}]*)\}", template) if m[0] != "{{"} - known)


def split_row(line: str) -> list[str]:
    """Trimmed cells of a table row; outer pipes are optional, an escaped pipe is part of its cell."""
    parts = re.findall(r"((?:\\.|[^|\\]|\\$)*)(\||$)", line.strip(), re.DOTALL)
    cells = [re.sub(r"\\\|", "|", text).strip() for text, _ in parts]
    cells = cells[1:] if len(cells) > 1 and not parts[0][0] and parts[0][1] else cells
    while len(cells) > 1 and not cells[-1] and not parts[-1][1]:  # nothing after the last pipe
        cells.pop()
        parts.pop()
    return cells


def autolinks(text: str) -> list[str]:
    """Bare web addresses, then mail addresses in what is left; closing marks at the end are not part of them."""
    out = []

    def take(m: re.Match) -> str:
        u = m[0]
        while u and (u[-1] in "?!.,:*_~'\"" or (u[-1] == ")" and u.count(")") > u.count("("))):
            u = u[:-1]
        out.append(u)
        return " " * len(m[0])

    left = re.sub(r"\b(?:https?://|www\.)[^\s<]+", take, text)
    out += re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]+", left)
    return out


def footnotes(text: str) -> list[tuple[int, str, str]]:
    """(number, label, text) of footnotes in the order of their first reference; unreferenced ones are left out."""
    notes = {m[1].lower(): m[2].strip() for m in reversed(list(re.finditer(r"(?m)^ {0,3}\[\^([^\]\s]+)\]:(.*)$", text)))}
    seen: dict[str, int] = {}
    for m in re.finditer(r"\[\^([^\]\s]+)\](?!:)", text):
        if m[1].lower() in notes:
            seen.setdefault(m[1].lower(), len(seen) + 1)
    return [(n, label, notes[label]) for label, n in seen.items()]


# --- numbers --------------------------------------------------------------------------------------


def exact_sum(values) -> float:
    """The exactly rounded sum; nulls are left out."""
    return math.fsum(v for v in values if v is not None)


#: Script calls that are understood, with the kinds of their arguments (fixed values): n number, s text,
#: b true or false, f a list of names or a text; what stands in brackets may be left out.
CALLS = {
    "AFNumber_Format": "nnnnsb", "AFNumber_Keystroke": "nnnnsb", "AFPercent_Format": "nn[b]", "AFPercent_Keystroke": "nn",
    "AFDate_Format": "n", "AFDate_FormatEx": "s", "AFDate_Keystroke": "n", "AFDate_KeystrokeEx": "s",
    "AFTime_Format": "n", "AFTime_FormatEx": "s", "AFTime_Keystroke": "n", "AFTime_KeystrokeEx": "s",
    "AFSpecial_Format": "n", "AFSpecial_Keystroke": "n", "AFSpecial_KeystrokeEx": "s", "AFRange_Validate": "bnbn", "AFSimple_Calculate": "sf",
}
_TOKEN = re.compile(
    r"""(?P<gap>[\x20\t\n\r\f\v\xa0\ufeff]+|//[^\n]*(?:\n|\Z)|/\*.*?\*/)
    |(?P<text>"(?:[^"\\\n\r]|\\["'\\nrt])*"|'(?:[^'\\\n\r]|\\["'\\nrt])*')
    |(?P<number>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<mark>[()\[\],;])""",
    re.S | re.X,
)
_TEXTS = r"(?:s(?:,s)*)?"
_ARGUMENT = rf"(?:[nsb]|\[{_TEXTS}\]|wA\({_TEXTS}\))"
_SHAPE = re.compile(rf"N\((?:{_ARGUMENT}(?:,{_ARGUMENT})*)?\);?")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def parse_call(script: str | None):
    """(name, arguments) if a script is exactly one known call with literal arguments of its kinds, else None; nothing is run.

    The script is cut into tokens, each becomes a letter, and the letters must have
    the shape of a call; comments and white space may stand anywhere.
    """
    letters, values, at = [], [], 0
    script = script or ""
    while at < len(script):
        m = _TOKEN.match(script, at)
        if not m:
            return None
        at = m.end()
        kind, t = m.lastgroup, m[0]
        if kind == "gap":
            continue
        if kind == "text":
            letter, value = "s", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), t[1:-1])
        elif kind == "number":
            letter, value = "n", float(t)
            if math.isinf(value):
                return None
        elif kind == "name":
            letter = "N" if not letters else {"true": "b", "false": "b", "new": "w", "Array": "A"}.get(t, "?")
            value = t == "true" if letter == "b" else t
        else:
            letter, value = t, None
        letters.append(letter)
        values.append(value)
    if not letters or not _SHAPE.fullmatch("".join(letters)) or values[0] not in CALLS:
        return None
    out, kinds, held = [], "", None
    for letter, value in zip(letters[2:], values[2:], strict=True):
        if letter in "[w":
            held = []
        elif held is not None and letter in ")]":
            out.append(held)
            kinds, held = kinds + "l", None
        elif letter in "nsb":
            if held is not None:
                held.append(value)
            else:
                out.append(value)
                kinds += letter
    want = re.escape(CALLS[values[0]]).replace(r"\[b\]", "b?").replace("f", "[sl]")
    return (values[0], out) if re.fullmatch(want, kinds) else None


def recalculate(values: dict[str, str], calculations: list[tuple[str, str]]) -> tuple[dict[str, str], list[str]]:
    """One pass over (field, script) in order: the values that change, and the fields whose script is not understood.

    A name stands for itself and for what lies below it in the dotted tree.
    """
    now, changed, unknown = dict(values), {}, []
    for field, script in calculations:
        call = parse_call(script)
        if not call or call[0] != "AFSimple_Calculate" or len(call[1]) != 2:
            unknown.append(field)
            continue
        kind, names = call[1]
        names = [x.strip() for x in names.split(",")] if isinstance(names, str) else names
        nums = []
        for k, v in now.items():
            if any(k == n or k.startswith(n + ".") for n in names):
                m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v.strip().replace(",", ".", 1))
                nums.append(float(m[0]) if m else 0.0)
        f: dict[str, Callable] = {"SUM": exact_sum, "AVG": lambda v: exact_sum(v) / len(v), "PRD": math.prod, "MIN": min, "MAX": max}
        if kind not in f:
            unknown.append(field)
            continue
        x = math.floor((f[kind](nums) if nums else 0.0) * 1e6 + 0.5) / 1e6
        new = str(int(x)) if x == int(x) else repr(x)
        if now.get(field) != new:
            now[field] = changed[field] = new
    return changed, unknown


# --- structure ----------------------------------------------------------------------------------------


def groups_by_place(boxes: list[tuple[float, float, float, float]], tolerance: float) -> list[list[int]]:
    """Boxes in first-come groups: a box joins the first group whose first box has every edge within the tolerance."""
    out: list[list[int]] = []
    for i, b in enumerate(boxes):
        home = next((g for g in out if all(abs(x - y) <= tolerance for x, y in zip(boxes[g[0]], b, strict=True))), None)
        home.append(i) if home else out.append([i])
    return out


def specificity(selector: str) -> int:
    """10000 for each id, 100 for each class, attribute and pseudo-class, 1 for each element."""
    s = re.sub(r":not\(", " ", re.sub(r"\[[^\]]*\]", ".a", selector))  # a negation counts as what it negates
    ids, classes = len(re.findall(r"#[\w-]+", s)), len(re.findall(r"\.[\w-]+|(?<!:):(?!:)[\w-]+", s))
    return 10000 * ids + 100 * classes + len(re.findall(r"(?:^|[\s>+~])[A-Za-z][\w-]*|::[\w-]+", s))


def cascade(declarations: list[tuple[int, str, int, str, str]]) -> dict[str, str]:
    """Winning values: (tier, selector, order, property, value); the highest tier, then specificity, then the last."""
    best: dict[str, tuple] = {}
    for tier, selector, order, prop, value in declarations:
        key = (tier, specificity(selector), order)
        if prop not in best or key >= best[prop][0]:
            best[prop] = (key, value)
    return {p: v for p, (_, v) in best.items()}


def css_length(expression: str, unit: dict[str, float]) -> float | None:
    """A length with calc(), min(), max() and clamp() in units given as numbers; null for anything else."""
    tokens = re.findall(r"\d+\.?\d*[a-z%]*|\.\d+[a-z%]*|[-+*/(),]|[a-z]+", expression.lower())
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def factor() -> float:
        t = take()
        if t in ("calc", "min", "max", "clamp"):
            if take() != "(":
                raise ValueError
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            if take() != ")":
                raise ValueError
            return {"calc": lambda: args[0], "min": lambda: min(args), "max": lambda: max(args), "clamp": lambda: max(args[0], min(args[1], args[2]))}[t]()
        if t == "(":
            x = total()
            if take() != ")":
                raise ValueError
            return x
        if t == "-":
            return -factor()
        m = re.fullmatch(r"(\d+\.?\d*|\.\d+)([a-z%]*)", t)
        if not m:
            raise ValueError
        return float(m[1]) * (unit[m[2]] if m[2] else 1.0)

    def product() -> float:
        x = factor()
        while peek() in ("*", "/"):
            x = x * factor() if take() == "*" else x / factor()
        return x

    def total() -> float:
        x = product()
        while peek() in ("+", "-"):
            x = x + product() if take() == "+" else x - product()
        return x

    try:
        x = total()
        return x if at == len(tokens) else None
    except (ValueError, KeyError, IndexError, ZeroDivisionError):
        return None


# --- metadata packets -----------------------------------------------------------------------------------

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def rdf_properties(packet: str) -> dict[str, object]:
    """Properties of an RDF packet by local name: text, a list (Bag, Seq), a map by language (Alt) or a map (structure)."""
    try:
        root = ET.fromstring(packet)
    except ET.ParseError:
        return {}

    def value(e: ET.Element):
        if len(e) == 1 and e[0].tag in (f"{_RDF}Bag", f"{_RDF}Seq"):
            return [value(x) for x in e[0]]
        if len(e) == 1 and e[0].tag == f"{_RDF}Alt":
            return {x.get("{http://www.w3.org/XML/1998/namespace}lang", "x-default"): value(x) for x in e[0]}
        inner = e[0] if len(e) == 1 and e[0].tag == f"{_RDF}Description" else e
        if len(inner):
            return {c.tag.rsplit("}", 1)[-1]: value(c) for c in inner}
        return (e.text or "").strip() if e.get(f"{_RDF}resource") is None else e.get(f"{_RDF}resource")

    out: dict[str, object] = {}
    for d in root.iter(f"{_RDF}Description"):
        out |= {k.rsplit("}", 1)[-1]: v for k, v in d.attrib.items() if not k.startswith(_RDF)}
        out |= {c.tag.rsplit("}", 1)[-1]: value(c) for c in d}
        break
    return out


# --- pictures --------------------------------------------------------------------------------------------


def diff_pixels(a: np.ndarray, b: np.ndarray, tolerance: int = 0) -> np.ndarray:
    """Where two pictures (rows, columns, channels) differ by more than the tolerance; a missing part counts as white."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    grow = lambda x: np.pad(x, ((0, h - x.shape[0]), (0, w - x.shape[1]), (0, 0)), constant_values=255)
    return (np.abs(grow(a).astype(int) - grow(b).astype(int)) > tolerance).any(2)


def changed_regions(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of 8-connected parts, from the top."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        most = np.max([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(mask, most, 0)
        if (new == label).all():
            break
        label = new
    out = []
    for v in np.unique(label[label > 0]):
        y, x = np.nonzero(label == v)
        out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return sorted(out, key=lambda r: (r[1], r[0]))
