"""The sender's own text of a stored message: header, quotations, disclaimers, signatures, markup and attachments cut away.

Plain functions over one message; nothing here needs Spark. Null and empty messages have no own text, damaged parts are
read as far as they go, and no text is too long (every step is one pass over lines).
"""

from __future__ import annotations

import base64
import html
import quopri
import re

#: A line of dashes with words between them: a message is attached below it as text.
_ORIGINAL = re.compile(r"^-{2,}\s*[^\W\d_][^-\n]{4,60}?\s*-{2,}(?=\s|$)")
_QUOTED = re.compile(r"^\s{0,3}(?:>|\|(?=\s|$|\|)|:(?=\s|$|:))")
_SIGNATURE = re.compile(r"^\s*(?:--\s?|—|_{5,}|\*(?:\s?\*){2,}|-{5,}|={5,}|~{3,})\s*$")
#: The lines of a leave-taking and a name: short, and no sentences.
_SHORT, _FEW = 45, 3
_ENDS = (".", "!", "?", ":", ";", ")", '"', "…")
_PARAGRAPH = re.compile(r"<\s*(?:/\s*p|br|/\s*div|/\s*li|/\s*tr|/\s*h[1-6])\b[^>]*>", re.I)
_HIDDEN = re.compile(r"<(style|script|head|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>|<[^<>]*\Z")


def _split_header(text: str) -> tuple[dict[str, str], str]:
    """Header fields in lower case (the first of each name) and the body."""
    head, sep, body = text.partition("\n\n")
    fields: dict[str, str] = {}
    name = ""
    for line in head.split("\n"):
        if line[:1] in " \t" and name:
            fields[name] += " " + line.strip()
        else:
            key, colon, value = line.partition(":")
            name = key.strip().lower() if colon and " " not in key.strip() else ""
            if name and name not in fields:
                fields[name] = value.strip()
            elif name:
                name = "\0"
                fields[name] = ""
    return fields, body if sep else ""


def _boundary(content_type: str) -> str | None:
    m = re.search(r'boundary\s*=\s*(?:"([^"]*)"?|([^\s;]+))', content_type, re.I)
    return (m[1] or m[2]) if m else None


def _decoded(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    try:
        if encoding == "base64":
            letters = re.sub(r"[^A-Za-z0-9+/]", "", body)
            raw = base64.b64decode(letters[: len(letters) // 4 * 4])
        elif encoding == "quoted-printable":
            raw = quopri.decodestring(body.encode("utf-8", "replace"))
        else:
            return body
    except ValueError:
        return body
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return raw.decode(charset or "latin-1", "replace")
        except LookupError:
            return raw.decode("latin-1")


def _charset(content_type: str) -> str:
    m = re.search(r'charset\s*=\s*"?([\w.-]+)', content_type, re.I)
    return m[1] if m else ""


def _parts(body: str, boundary: str) -> list[str]:
    """The parts of a multipart body, attachments left out."""
    parts = []
    for piece in body.split("--" + boundary)[1:]:
        if piece.startswith("--"):
            break
        piece = piece.removeprefix("\n")
        inner = piece.partition("\n\n")[0].lower()
        if "content-disposition: attachment" in inner or "application/" in inner.split("\n")[0]:
            continue
        parts.append(piece if ":" in piece.split("\n", 1)[0] else "\n\n" + piece)
    return parts


def body_text(text: str) -> tuple[str, bool]:
    """The message's readable part and whether it is HTML: the first plain part, else the first HTML part, at any depth."""
    stack, nested = [text], False
    best: tuple[str, bool] | None = None
    while stack:
        fields, body = _split_header(stack.pop())
        kind = fields.get("content-type", "text/plain")
        low = kind.lower()
        boundary = _boundary(kind) if low.startswith("multipart") else None
        if boundary:
            nested = True
            stack.extend(reversed(_parts(body, boundary)))
            continue
        if low.startswith("multipart"):
            got = body, False
        elif not low.startswith("text/") and "content-type" in fields:
            got = "", False
        else:
            out = _decoded(body, fields.get("content-transfer-encoding", ""), _charset(kind))
            got = out, low.startswith("text/html") or out.lstrip()[:6].lower() == "<html>"
        if not nested:
            return got
        if got[0].strip() and not got[1]:
            return got
        if got[0].strip() and best is None:
            best = got
    return best or ("", False)


def _plain(markup: str) -> str:
    """HTML as text: a blank line between paragraphs, hidden parts and tags gone, references resolved."""
    text = _HIDDEN.sub(" ", markup)
    text = _PARAGRAPH.sub("\n\n", text)
    return html.unescape(_TAG.sub(" ", text))


def _repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 put right, where it is that."""
    if "Ã" in text or "Â" in text:
        pairs = re.sub(r"[Â-ô][-¿]+", lambda m: _try_utf8(m[0]), text)
        return pairs
    return text


def _try_utf8(s: str) -> str:
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return s


#: The widest line that still counts as one; what is longer was not broken by its sender and is shown as several.
LINE = 132


def own_text(message: str | None) -> list[str]:
    """The paragraphs that the sender wrote, without greeting, leave-taking and signature."""
    return [" ".join(lines) for lines in own_lines(message)]


def lines_of(paragraphs: list[list[str]]) -> int:
    """How many lines the paragraphs of `own_lines` fill."""
    return sum(-(-len(line) // LINE) for lines in paragraphs for line in lines)


def own_lines(message: str | None) -> list[list[str]]:
    """`own_text` as the lines of each paragraph."""
    if not message:
        return []
    body, is_html = body_text(message.replace("\r\n", "\n"))
    if is_html:
        blocks = [" ".join(x.split()) for x in re.split(r"\n\s*\n", _repaired(_plain(body)))]
        return _own([[x] for x in blocks if x], flat=True)
    return _own(_blocks(_repaired(body)), flat=False)


def _blocks(text: str) -> list[list[str]]:
    """Stretches of lines between blank ones; an empty stretch stands for two blank lines or more."""
    blocks: list[list[str]] = [[]]
    blanks = 0
    for line in text.split("\n"):
        if line.strip():
            if blanks:
                blocks += [[], []] if blanks > 1 else [[]]
            blocks[-1].append(line)
            blanks = 0
        else:
            blanks += 1
    return blocks if blocks[0] else blocks[1:]


def _own(blocks: list[list[str]], flat: bool) -> list[list[str]]:
    """The sender's paragraphs. flat: each block is one line, as HTML leaves it."""
    out: list[list[str]] = []
    stretch: list[list[str]] = []  # paragraphs since the last quotation
    attached = _attached(blocks, flat)
    for k, block in enumerate(blocks):
        if attached and attached[0] <= k < attached[1]:
            out += _written(stretch, out)
            stretch = []
            continue
        own: list[str] = []
        signed = False
        for line in block:
            if _QUOTED.match(line):
                if own:
                    stretch.append(own)
                # What leads to a quotation (who wrote when) is not the sender's own either.
                if stretch and stretch[-1][-1].endswith(":") and sum(map(len, stretch[-1])) < 250:
                    stretch.pop()
                out += _written(stretch, out)
                stretch, own, signed = [], [], False
            elif _SIGNATURE.match(line):
                signed = True
            elif not signed:
                own.append(line.strip())
        if flat and own and (m := re.search(r"\s(?:--|_{5,}|\*(?:\s?\*){2,})\s", own[0])) and len(own[0]) < 250:
            own = [own[0][: m.start()]]
        if own:
            stretch.append(own)
    return out + _written(stretch, out)


def _written(stretch: list[list[str]], before: list[list[str]]) -> list[list[str]]:
    """The paragraphs of one stretch without greeting, contact lines and leave-takings; nothing of it stands behind the last one."""
    out: list[list[str]] = []
    for p in stretch:
        if not _is_contact(p) and not (not before and not out and _is_greeting(p)):
            out.append(p)
    cuts = [_leave(p, k > 0 or bool(before)) for k, p in enumerate(out)]
    last = max((k for k, c in enumerate(cuts) if c < len(out[k])), default=len(out))
    return [p[:c] for p, c in zip(out[: last + 1], cuts) if c]


def _attached(blocks: list[list[str]], flat: bool) -> tuple[int, int] | None:
    """The blocks from an attached message's line of dashes on; up to the end unless the message begins with it.

    Above the sender's text the attached one ends with two blank lines or, without any, with the last quotation inside it;
    where there is neither, as in HTML, nothing tells the two apart and no text is the sender's.
    """
    first = next((k for k, b in enumerate(blocks) if any(_ORIGINAL.match(x.strip()) for x in b)), None)
    if first is None:
        return None
    if any(b and not any(_ORIGINAL.match(x.strip()) or _QUOTED.match(x) for x in b) for b in blocks[:first]):
        return first, len(blocks)
    gap = next((k for k in range(first + 1, len(blocks)) if not blocks[k]), None)
    if gap is None:
        quoted = [k for k in range(first, len(blocks)) if any(_QUOTED.match(x) for x in blocks[k])]
        gap = quoted[-1] + 1 if quoted else None
    return (first, len(blocks) if gap is None else gap)


def _leave(lines: list[str], later: bool) -> int:
    """The number of lines before a leave-taking at the end of a paragraph: all of them if there is none.

    It is up to three short lines that are no sentences: the whole of a later paragraph, or the end of one behind a line
    that ends a sentence.
    """
    k = len(lines)
    while k and len(lines) - k < _FEW and len(lines[k - 1]) < _SHORT and not lines[k - 1].endswith(_ENDS):
        k -= 1
    if (k and not lines[k - 1].endswith((".", "!", "?"))) or (not k and not later):
        return len(lines)
    return k


def _is_greeting(lines: list[str]) -> bool:
    text = " ".join(lines)
    return len(lines) == 1 and text.endswith((",", "!")) and len(text) < _SHORT and len(text.split()) <= 4


def _is_contact(lines: list[str]) -> bool:
    """A telephone number, an address or the like, left on a line of its own."""
    text = " ".join(lines)
    return len(text.split()) <= 5 and not text.endswith((".", "!", "?")) and any(c.isdigit() or c == "@" for c in text)
