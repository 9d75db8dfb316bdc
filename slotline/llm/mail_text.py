"""What a mail's sender wrote: headers and transfer encodings undone, quoted chain, signature and hidden parts left out."""

from __future__ import annotations

import base64
import html
import quopri
import re
from dataclasses import dataclass, field

_HEADER_END = re.compile(r"\n[ \t]*\n")
_BOUNDARY = re.compile(r'boundary="?([^";\n]+)"?', re.I)
_CHARSET = re.compile(r'charset="?([\w.-]+)', re.I)
_HIDDEN = re.compile(r"(?is)<(script|style|head|pre|code|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<(\w+)[^>]*style=[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)[^>]*>.*?</\2\s*>|<(\w+)[^>]*\shidden\b[^>]*>.*?</\3\s*>")
_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title>")
_BREAK = re.compile(r"(?i)<br\s*/?>|</(?:p|div|li|tr|h\d|blockquote)\s*>")
_QUOTE_BLOCK = re.compile(r"(?is)<blockquote\b.*?</blockquote\s*>")
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|![^<>]*)>")
_FORWARD = re.compile(r"(?i)^-{2,}\s*(original message|forwarded message|urspr|message d'origine|mensaje original)")
_FENCE = re.compile(r"(?s)```.*?(?:```|\Z)")
_ATTRIBUTION = re.compile(r"<[^<>@\s]+@[^<>\s]+>.{0,40}[:：]\s*$")


@dataclass
class OwnText:
    lines: list[str] = field(default_factory=list)
    title: str = ""


def _headers(block: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", block).split("\n"):
        name, colon, value = line.partition(":")
        if colon and " " not in name:
            out.setdefault(name.lower(), value.strip())
    return out


def _decoded(body: str, head: dict[str, str]) -> str:
    how = head.get("content-transfer-encoding", "").lower()
    if how not in ("base64", "quoted-printable"):
        return body
    try:
        if how == "base64":
            letters = re.sub(r"[^A-Za-z0-9+/]", "", body)
            raw = base64.b64decode(letters[: len(letters) // 4 * 4] + {0: "", 1: "", 2: letters[-2:] + "==", 3: letters[-3:] + "="}[len(letters) % 4])
        else:
            raw = quopri.decodestring(body.encode("utf-8"))
        charset = m[1] if (m := _CHARSET.search(head.get("content-type", ""))) else "utf-8"
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            return raw.decode("utf-8", "replace")
    except ValueError:
        return body


def _parts(text: str, depth: int = 0) -> list[tuple[str, str]]:
    """(type, decoded text) of the shown text parts."""
    end = _HEADER_END.search(text)
    if text.startswith("\n"):
        head, body = {}, text[1:]
    elif end:
        head, body = _headers(text[: end.start()]), text[end.end() :]
    else:
        head, body = (_headers(text), "") if depth else ({}, text)
    if not depth and not head:
        body = text
    kind = head.get("content-type", "text/plain").lower()
    if kind.startswith("multipart/") and (m := _BOUNDARY.search(head.get("content-type", ""))) and depth < 8:
        pieces = re.split(rf"(?:^|\n)--{re.escape(m[1].strip())}(?:--)?[ \t]*(?=\n|$)", body)[1:]
        return [p for x in pieces if x.strip() for p in _parts(x[1:] if x.startswith("\n") else x, depth + 1)]
    if "attachment" in head.get("content-disposition", "").lower() or "name=" in kind or not kind.startswith("text/"):
        return []
    return [(kind.split(";")[0].strip(), _decoded(body, head))]


def _shown(markup: str) -> str:
    text = _HIDDEN.sub(" ", markup)
    text = _QUOTE_BLOCK.sub("\n", text)
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))


def own_text(mail: str | None) -> OwnText:
    """The sender's own lines; none for a NULL, empty or blank mail. Plain parts go before HTML ones."""
    if not mail or not mail.strip():
        return OwnText()
    mail = mail.replace("\r\n", "\n").replace("\r", "\n")
    if mail.startswith("From ") and "\n" in mail:
        mail = mail.split("\n", 1)[1]
    parts = _parts(mail)
    plain = [t for k, t in parts if k == "text/plain" and t.strip()]
    markup = [t for k, t in parts if k != "text/plain"]
    title = " ".join(html.unescape(m[1]).strip() for t in markup if (m := _TITLE.search(t)))
    lines = []
    for text in plain or [_shown(t) for t in markup]:
        for line in _FENCE.sub("\n", text.replace("\r\n", "\n")).split("\n"):
            line = line.strip()
            if line == "--" or _FORWARD.match(line):
                break
            if line and not line.startswith((">", "|")) and not _ATTRIBUTION.search(line):
                lines.append(line)
    return OwnText(lines, title)
