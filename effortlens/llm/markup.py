"""HTML to text lines, each marked as content, boilerplate or undecided by the markup around it."""

from __future__ import annotations

import html
import re

KEEP, DROP, OPEN = 1, 2, 0
#: Of elements inside a line: they are left out of it and do not end it.
_LEFT_OUT = 3

_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select"
_ENDS = {raw: re.compile(rf"</{raw}\s*>", re.I) for raw in (*_RAW.split("|"), "title")}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>(?>[^<>"']+|"[^"<]*"|'[^'<]*')*+)>"""
    r"|<[a-zA-Z/!?][^<>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Names that tell what a page or block has or is, not what it is for: has-sidebar, no-sidebar, cookie-consent-open, comments-closed.
_STATE = re.compile(r"(?:has|is|no|not|with|without)(?=[-_A-Z]).*|.*(?:[-_]|(?<=[a-z])(?=[A-Z]))(?:open|opened|closed|enabled|disabled|active|visible|shown|on|off)", re.S)
_ROOT = re.compile(r"<main\b|<article\b", re.I)

# Elements that end a line of text, and of those the ones that nest.
_NESTING = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header "
    "html li main menu nav ol pre section summary table tbody tfoot thead tr ul".split()
)
_BLOCK = _NESTING | frozenset("h1 h2 h3 h4 h5 h6 hr p caption".split())
_GAP = frozenset("br td th img option wbr".split())
# What may stand in <head>; anything else ends it, as its end tag may be left out.
_HEAD = frozenset("head title meta link base basefont bgsound script style noscript template noframes object".split())
# Boilerplate by element and by the words of class, id and role.
_DROP_TAGS = frozenset("nav footer aside form menu dialog button".split())
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments reply replies respond "
    "discussion disqus widget pagination pager search contentinfo complementary".split()
)


def _names(rest: str, inside: bool, tag: str) -> int:
    """2 if a class, id or role is a word of boilerplate, 1 if a part of one is, else 0."""
    found = 0
    for mark in _MARKS.findall(rest):
        for name in next(filter(None, mark), "").split():
            if _STATE.fullmatch(name):
                continue
            top = not inside and tag != "h1"
            if name.lower() in _DROP_WORDS or (top and name.lower() == "header"):
                return 2
            words = {w.lower() for w in _PARTS.findall(name)}
            if words & _DROP_WORDS or (top and "header" in words):
                found = 1
    return found


def _judged(tag: str, rest: str, inside: bool) -> tuple[bool, int]:
    """(whether an element is boilerplate whatever stands in it, how far its names say that it is: see ``_names``).

    ``inside``: it stands in the article. The page, its body and <main> are never boilerplate by name,
    an <article> only by a whole word, as lists of comments and teasers are made of articles too.
    """
    if tag in _DROP_TAGS or (tag == "header" and not inside) or (rest and _HIDDEN.search(rest)):
        return tag not in ("html", "body"), 0
    if "=" not in rest or tag in ("html", "body", "main"):
        return False, 0
    named = _names(rest, inside, tag)
    return False, 0 if tag == "article" and named < 2 else named


def lines(page: str) -> list[tuple[str, int]]:
    """(text, KEEP | DROP | OPEN) of each line of text, in page order.

    A name drops no element in which the content of the page turns out to stand: the first <main>, or
    else the first <article>; a name of which only a part speaks drops none in which any of them does.
    Such an element is found when its content begins, and the page is then read again.
    """
    roots = list(_ROOT.finditer(page))
    root = next((m.start() for m in roots if m[0].lower() == "<main"), roots[0].start() if roots else -1)
    spared: frozenset[int] = frozenset()
    while True:
        out, more = _read(page, root, spared)
        if more <= spared:
            return out
        spared |= more


def _read(page: str, root: int, spared: frozenset[int]) -> tuple[list[tuple[str, int]], set[int]]:
    """(lines, starts of elements dropped by name in which content stands); those of ``spared`` are not dropped."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    by_name: dict[int, tuple[int, int]] = {}  # place in the stack -> start and how far the name speaks
    wrong: set[int] = set()
    n_drop = n_keep = n_left_out = 0
    at = 0
    in_head = False
    endless: set[str] = set()  # names without an end tag from here on

    def flush() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((text, DROP if n_drop else KEEP if n_keep else OPEN))
            parts.clear()

    def after(name: str, start: int) -> int | None:
        """Where the element's end tag ends; null if it has none."""
        found = None if name in endless else _ENDS[name].search(page, start)
        if found is None:
            endless.add(name)
        return found and found.end()

    def close(k: int) -> None:
        nonlocal n_drop, n_keep, n_left_out
        for place in range(k, len(stack)):
            kind = stack[place][1]
            n_drop -= kind == DROP
            n_keep -= kind == KEEP
            n_left_out -= kind == _LEFT_OUT
            by_name.pop(place, None)
        del stack[k:]

    def leave_head() -> None:
        nonlocal in_head
        in_head = False
        flush()
        close(next((k for k, (name, _) in enumerate(stack) if name == "head"), len(stack)))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            if in_head and stack and stack[-1][0] == "head" and not page[at : m.start()].isspace():
                leave_head()
            if not n_left_out:
                parts.append(page[at : m.start()])
        at = m.end()
        raw, tag = m["raw"], m["tag"]
        if raw:
            raw = raw.lower()
            if in_head and raw not in _HEAD:
                leave_head()
            end = after(raw, at)
            if end is None and raw not in ("script", "style"):  # an ordinary dropped element
                flush()
                stack.append((raw, DROP))
                n_drop += 1
                continue
            at = len(page) if end is None else end
            parts.append(" ")
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not m["end"]:
            if in_head and tag not in _HEAD:
                leave_head()
            if tag == "head":
                flush()
                in_head = True
                stack.append((tag, DROP))
                n_drop += 1
                continue
            if in_head and tag == "title" and (end := after(tag, at)):
                at = end
                continue
        if tag in _BLOCK:
            flush()
        elif tag in _GAP:
            parts.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(kind == DROP for _, kind in stack[k:]):
                        flush()
                    close(k)
                    break
            continue
        if tag in _BLOCK and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        rest = m["rest"]
        surely, named = _judged(tag, rest, n_keep > 0)
        if m.start() in spared:
            named = 0
        kind = DROP if surely or named else KEEP if tag in ("article", "main") else OPEN
        if kind == DROP and tag not in _BLOCK:
            kind = _LEFT_OUT
        if tag in ("article", "main"):
            first = m.start() == root
            wrong.update(start for start, how in by_name.values() if first or how == 1)
            if first and named:
                wrong.add(m.start())
        if (tag in _NESTING or kind in (DROP, _LEFT_OUT)) and not rest.endswith("/") and tag not in _GAP and tag not in ("hr", "input", "link", "meta"):
            if named and not surely:
                by_name[len(stack)] = (m.start(), named)
            stack.append((tag, kind))
            n_drop += kind == DROP
            n_keep += kind == KEEP
            n_left_out += kind == _LEFT_OUT
    if at < len(page):
        if in_head and stack and stack[-1][0] == "head" and not page[at:].isspace():
            leave_head()
        if not n_left_out:
            parts.append(page[at:])
    flush()
    return out, wrong
