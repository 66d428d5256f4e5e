"""A markdown text as units that can be cited: sentences, table rows, code blocks, each with its place and its heading. text[offset:offset+length] is the unit.

Offsets count UTF-16 units, as browsers do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pageloom.operators.markup import WS

# What ends sentences, what may follow an end, words whose stop ends nothing.
CJK_ENDS, CLOSERS = "。．！？；।॥", "\"')\\]”’»*_"
ABBREVIATIONS = frozenset(
    """mr mrs ms dr prof sr jr st ave blvd vs etc inc ltd corp dept univ assn approx appt apt est min max govt lib misc natl intl
    jan feb mar apr jun jul aug sep oct nov dec mon tue wed thu fri sat sun fig eq ref vol no pp ed rev e i""".split()
)
MIN_CHARS = 2

_S = f"[{WS}]"
_END = re.compile(rf"""(?P<cjk>[{CJK_ENDS}])|(?P<stop>[.!?]+[{re.escape(CLOSERS)}]*)(?P<cite>(?:\[\\\[[^\]\n]{{1,40}}\\\]\]\(\#[^)\s]*\))*)""".replace(r"\#", "#"))
_FENCE = re.compile(r"`{3,}|~{3,}")
_HEADING = re.compile(rf"#{{1,6}}(?:{_S}+(.*?))?{_S}*#*{_S}*$")
_DELIMITER = re.compile(rf"\|?(?:{_S}|[:|-])*-(?:{_S}|[:|-])*\|?$")
_BREAK = re.compile(rf"(?:-{_S}*){{3,}}$|(?:\*{_S}*){{3,}}$|(?:_{_S}*){{3,}}$|<!--.*-->$|!\[[^\]]*\]\([^)]*\)$", re.S)
_MARKS = re.compile(rf"(?:>{_S}?)*(?:(?:[-*+]|[0-9]{{1,9}}[.)]){_S}+)?")


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    left = len(part) - len(part.lstrip(_SPACES))
    return start + left, start + max(left, len(part.rstrip(_SPACES)))


_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def false_stop(word: str) -> bool:
    """Whether a full stop after this word ends no sentence."""
    if not word:
        return False
    return re.sub(r"[^a-z]", "", word.lower()) in ABBREVIATIONS or bool(re.search(r"[A-Za-z0-9_]\.[A-Za-z0-9_]", word)) or bool(re.fullmatch(r"[A-Z]", word))


def sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    begin = at = start
    while m := _END.search(text, at, end):
        at = m.end()
        if m["cjk"]:
            yield begin, at
            begin = at
            continue
        if at < end and text[at] not in _SPACES:
            continue
        if text[m.start()] == "." and not m["cite"]:
            word = m.start()
            while word > begin and text[word - 1] not in _SPACES:
                word -= 1
            if false_stop(text[word : m.start()]):
                continue
        yield begin, at
        begin = at
    if begin < end:
        yield begin, end


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of headings, table rows, code blocks and paragraphs."""
    fence, para, at = None, None, 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        s, e = _trim(text, at, stop)
        line = text[s:e]
        if fence:
            mark, inside = fence
            if line and line[0] == mark[0] and len(line) >= len(mark) and not line.strip(mark[0]):
                yield "code_block", inside, max(inside, at)
                fence = None
            at = stop + 1
            continue
        opens, heading = _FENCE.match(line), _HEADING.match(line)
        row, gap = line[:1] == "|", not line or bool(_BREAK.match(line))
        content = s + _MARKS.match(line).end() if not (opens or heading or row or gap) else s
        if para and (opens or heading or row or gap or content > s):
            yield "paragraph", *para
            para = None
        if opens:
            fence = (opens[0], min(stop + 1, len(text)))
        elif heading:
            yield "heading", s + heading.start(1) if heading[1] else e, s + heading.end(1) if heading[1] else e
        elif row:
            if not _DELIMITER.match(line):
                yield "table_row", s, e
        elif not gap:
            para = (para[0] if para else content, e)
        at = stop + 1
    if fence:
        yield "code_block", fence[1], len(text)
    if para:
        yield "paragraph", *para


def segment(text: str | None) -> list[dict]:
    """Units in order: text, kind, offset, length, heading."""
    if not text:
        return []
    out, heading = [], None
    astral = not text.isascii() and any(ord(c) > 0xFFFF for c in text)
    units16 = (lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2) if astral else len
    known, place = 0, 0
    for kind, start, end in _blocks(text):
        if kind == "heading":
            heading = text[start:end].strip(_SPACES) or None
            continue
        for s, e in sentences(text, start, end) if kind == "paragraph" else [(start, end)]:
            s, e = _trim(text, s, e)
            body = text[s:e]
            if len(body) < MIN_CHARS:  # it is trimmed: its first and its last character are no space
                continue
            place += units16(text[known:s])
            known = s
            out.append({"text": body, "kind": "sentence" if kind == "paragraph" else kind, "offset": place, "length": units16(body), "heading": heading})
    return out
