"""Reading raw e-mails: the subject and the sender's own words, decoded.

A light reader for mails kept as text. It never fails: what is malformed is
taken as it stands.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

#: The line that stands between the parts of a message.
NEXT_PART = "\f"
_HEADER = re.compile(r"([!-9;-~]+)[ \t]*:[ \t]*(.*)")
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN_WORDS = re.compile(r"(=\?[^?\s]+\?[bBqQ]\?[^?]*\?=)\s+(?==\?)")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([^\s";]+)', re.I)
_HIDDEN = re.compile(r"<(style|script|head|title|blockquote)\b|<!--", re.I)
_BREAK = re.compile(r"<(?:br|/p|/div|/tr|/li|/h[1-6]|/table|/ul|/ol|p|div|tr|li|h[1-6])\b[^<>]*>[ \t]*\n?", re.I)
_TAG = re.compile(r"<[/!a-zA-Z][^<>]*>")
# Where older text begins below one's own words: separator lines and lines of attribution.
_SEPARATOR = re.compile(r"\s*(?:-{3,}\s*(?:Original|Ursprüngliche|Message d'origine|Mensaje original|Mensagem original|Forwarded|Weitergeleitete|Message transféré|Mensaje reenviado|元のメッセージ|मूल संदेश)[^\n]*|_{20,}\s*)$", re.I)
_WROTE = re.compile(r"\s*(?:On|Am|Le|El|Em|Il)\b.{4,160}\b(?:wrote|schrieb|a écrit|écrit|escribió|escreveu|ha scritto)\b.{0,80}:\s*$|.{4,160}(?:さんは書きました|のメッセージ|ने लिखा)\s*[:：]\s*$", re.I)


def _bytes_text(data: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8", "cp1252"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def header_text(value: str) -> str:
    """A header with its encoded words decoded."""

    def word(m: re.Match) -> str:
        charset, kind, body = m.group(1), m.group(2).lower(), m.group(3)
        try:
            data = base64.b64decode(body + "===") if kind == "b" else quopri.decodestring(body.replace("_", " ").encode("latin-1", "replace"))
        except (binascii.Error, ValueError):
            return m.group(0)
        return _bytes_text(data, charset)

    return _WORD.sub(word, _BETWEEN_WORDS.sub(r"\1", value)) if "=?" in value else value


def split_headers(text: str) -> tuple[dict[str, str], str]:
    """The first of each header (names in lower case, unfolded) and the body.

    A text that doesn't begin with headers is all body. Empty lines before the
    headers and an envelope line are passed over.
    """
    lines = text.split("\n")
    headers: dict[str, str] = {}
    last = None
    k = next((k for k, line in enumerate(lines) if line.strip()), len(lines))
    if k < len(lines) and lines[k].startswith(("From ", ">From ")):
        k += 1
    while k < len(lines) and lines[k].strip():
        line = lines[k]
        if line[0] in " \t" and last is not None:
            headers[last] += " " + line.strip()
        elif m := _HEADER.match(line):
            last = m.group(1).lower()
            if last in headers:
                last += "\u0001"  # a repeated header; its first value counts
            headers[last] = m.group(2)
        else:
            break  # the empty line is missing
        k += 1
    if not headers:
        return {}, text
    return headers, "\n".join(lines[k + 1 if k < len(lines) and not lines[k].strip() else k :])


def _decoded(body: str, encoding: str, charset: str | None) -> str:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            return _bytes_text(base64.b64decode(packed[: len(packed) // 4 * 4] if len(packed) % 4 == 1 else packed + "=" * (-len(packed) % 4)), charset)
        except (binascii.Error, ValueError):
            return body
    if encoding == "quoted-printable":
        return _bytes_text(quopri.decodestring(body.encode("utf-8")), charset)
    return body


def _without_hidden(markup: str) -> str:
    """Without comments and elements that a page doesn't show, or shows as quoted.

    An element that isn't closed stays; each kind of end is looked for until it
    is missing once, so that the time stays linear.
    """
    out, at, missing = [], 0, set()
    for m in _HIDDEN.finditer(markup):
        if m.start() < at:
            continue
        name = (m.group(1) or "--").lower()
        if name in missing:
            continue
        end = re.compile("-->" if name == "--" else rf"</{name}\s*>", re.I).search(markup, m.end())
        if end is None:
            missing.add(name)
            continue
        out += [markup[at : m.start()], " "]
        at = end.end()
    return "".join([*out, markup[at:]])


def html_text(markup: str) -> str:
    """The text that a page shows, a line a block."""
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _without_hidden(markup))))


def _is(headers: dict[str, str], kind: str) -> bool:
    return headers.get("content-type", "text/plain").lower().lstrip().startswith(kind)


def _attached(headers: dict[str, str]) -> bool:
    return headers.get("content-disposition", "").lower().lstrip().startswith("attachment")


def _inner(headers: dict[str, str], body: str) -> list[tuple[dict[str, str], str]] | None:
    """Headers and body of each part of a multipart; None for what has no parts, or no boundary that tells them apart."""
    if _attached(headers) or not _is(headers, "multipart/"):
        return None
    m = _BOUNDARY.search(headers["content-type"])
    if not m or (mark := "--" + (m.group(1) or m.group(2) or "")) == "--":
        return None
    chunks = re.split(rf"^{re.escape(mark)}(?:--)?[ \t]*$", body, flags=re.M)
    parts = [c.removeprefix("\n") for c in chunks[1:] if c.strip()]
    return [({}, p) if p.startswith("\n") else split_headers(p) for p in parts] if len(chunks) > 1 else None


def _texts(headers: dict[str, str], body: str) -> tuple[list[str], list[str]]:
    """The plain and the HTML text of what has no parts; a multipart without them is plain text."""
    if _attached(headers) or not (_is(headers, "text/") or _is(headers, "multipart/")):
        return [], []
    charset = m.group(1) if (m := _CHARSET.search(headers.get("content-type", ""))) else None
    text = _decoded(body, headers.get("content-transfer-encoding", ""), charset)
    return ([], [html_text(text)]) if _is(headers, "text/html") else ([text], [])


def _parts(headers: dict[str, str], body: str) -> tuple[list[str], list[str]]:
    """The plain and the HTML texts of a mail that are no attachments, however deep its parts are nested."""
    # of each multipart that is open: is it a choice of alternatives, its parts to come, its texts so far
    stack = [(True, iter([(headers, body)]), [], [])]
    while True:
        choice, parts, plain, marked = stack[-1]
        part = next(parts, None)
        if part is not None:
            if (inner := _inner(*part)) is not None:
                stack.append((_is(part[0], "multipart/alternative"), iter(inner), [], []))
                continue
            p, h = _texts(*part)
        else:
            stack.pop()
            if not stack:
                return plain, marked
            p, h = plain, marked
            choice, _, plain, marked = stack[-1]
        if choice:
            plain += [] if plain else p
            marked += [] if marked else h
        else:
            plain += p or h
            marked += h


def own_lines(text: str) -> list[str]:
    """The lines outside older text: without marked quotes, and above unmarked ones.

    Below a line of attribution older text is marked line by line, and one's own
    words may go on after it; or it isn't marked, and goes on to the end, as it
    does below a separator line.
    """
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines):
        mark = line.lstrip()[:1]
        if mark in (">", "|"):
            continue
        if mark == "-" and _SEPARATOR.match(line):
            break
        if _WROTE.match(line):
            following = next((x.lstrip() for x in lines[k + 1 :] if x.strip()), "")
            if following[:1] not in (">", "|"):
                break
            continue
        out.append(line)
    return out


def read(text: str | None) -> tuple[str, list[str]]:
    """The subject and the lines of the sender's own message of a mail, its parts parted by ``NEXT_PART``."""
    if not text or not text.strip():
        return "", []
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    headers, body = split_headers(t)
    plain, marked = _parts(headers, body)
    shown = [p for p in plain if p.strip()] or marked
    lines: list[str] = []
    for p in shown:
        lines += [NEXT_PART] if lines else []
        lines += own_lines(p.replace("\r\n", "\n").replace("\r", "\n"))
    return header_text(headers.get("subject", "")), lines
