"""Plain text and declared language of html pages, in time linear in a page whatever it holds."""

from __future__ import annotations

import re

#: Names are matched in ASCII, in any case; the end of a word (\b) is that of any script.
_OPEN = re.compile(r"<((?ai:script|style))\b|<!--")
_CLOSE = {k: re.compile(rf"(?ai:</{k}\s*>)") for k in ("script", "style")}
_MARK = re.compile(r"<[^>]*>|&[a-zA-Z#0-9]{1,10};")
_ENTITY = re.compile(r"&[a-zA-Z#0-9]{1,10};")
_VALUE = r"(?a:\s*=\s*(?:[\"']\s*)?)([a-zA-Z]{2,3})\b"
_TAG, _HTML, _META = (re.compile(rf"(?ai:{x})") for x in (r"<(?:html|meta\s)", r"<html", r"<meta\s"))
_LANG, _XML, _CONTENT = (re.compile(x + _VALUE) for x in (r"(?ai:\slang)", r"(?ai:\sxml:lang)", r"(\b(?ai:content))"))
_ABOUT = re.compile(r"(?ai:http-equiv\s*=\s*[\"']?content-language)\b")


def without_hidden(html: str) -> str:
    """A page with each script, style element and comment that is closed as one blank; an opening that nothing closes stays.

    Once a kind of closing isn't found behind a place, it isn't looked for again behind later ones.
    """
    out, at, pos, gone = [], 0, 0, set()
    while len(gone) < 3 and (m := _OPEN.search(html, pos)):
        kind, end = (m[1] or "!").lower(), -1
        if kind == "!" and kind not in gone:
            end = html.find("-->", m.end())
            end = end + 3 if end >= 0 else end
        elif kind not in gone:
            tag = html.find(">", m.end())
            if tag < 0:
                gone |= {"script", "style"}
            elif close := _CLOSE[kind].search(html, tag + 1):
                end = close.end()
        if end < 0:
            gone.add(kind)
            pos = m.start() + 1
            continue
        out += (html[at : m.start()], " ")
        at = pos = end
    return "".join(out) + html[at:]


def plain(html: str) -> str:
    """The text of a page: hidden parts, tags and entities are one blank each; a ``<`` that no ``>`` follows is text."""
    shown = without_hidden(html)
    cut = shown.rfind(">") + 1
    return _MARK.sub(" ", shown[:cut]) + _ENTITY.sub(" ", shown[cut:])


def _last(pattern: re.Pattern, text: str) -> re.Match | None:
    found = None
    for found in pattern.finditer(text):
        pass
    return found


def declared(html: str) -> str:
    """The two or three letters of the first html tag with a lang, else with an xml:lang, else of a meta tag's content-language, that one before its content or after; in lower case, empty if there is none. Of several attributes of a tag the last counts."""
    found, pos = [""] * 4, 0
    while not found[0] and (m := _TAG.search(html, pos)):
        end = html.find(">", m.end())
        pos = len(html) if end < 0 else end
        part = html[m.start() : pos]
        if h := _HTML.search(part):
            for i, pattern in ((0, _LANG), (1, _XML)):
                if not found[i] and (x := _last(pattern, part[h.end() :])):
                    found[i] = x[1]
        if (h := _META.search(part)) and (about := list(_ABOUT.finditer(part, h.end()))):
            contents = list(_CONTENT.finditer(part, h.end()))
            after = [x[2] for x in contents if x.start() > about[0].end() and part[x.start() - 1] in " \t\n\x0b\f\r"]
            before = [x[2] for x in contents if x.end(1) < about[-1].start()]
            found[2:] = found[2] or (after or [""])[-1], found[3] or (before or [""])[-1]
    return next((x for x in found if x), "").lower()
