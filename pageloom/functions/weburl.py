"""Web addresses as browsers read them: parsing against a base, normal forms, percent-encoding. Plain Python, for Arrow functions."""

from __future__ import annotations

import ipaddress
import re
from typing import NamedTuple
from urllib.parse import quote_from_bytes, unquote_to_bytes

# Schemes that have an authority, with their ports; characters kept as they are in each part of an address.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_KEEP_USER = "!$%&'()*+,-._~"
_KEEP_PATH = "!$%&'()*+,-./:;=@[\\]_|~^"
_KEEP_QUERY_SPECIAL = "!$%&()*+,-./:;=?@[\\]^_`{|}~"
_KEEP_QUERY = _KEEP_QUERY_SPECIAL + "'"
_KEEP_FRAGMENT = "!#$%&'()*+,-./:;=?@[\\]^_{|}~"
_KEEP_COMPONENT = "!'()*-._~"
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")


def encode(text: str, keep: str) -> str:
    return quote_from_bytes(text.encode("utf-8", "replace"), safe=keep)


def encode_component(text: str) -> str:
    """A value for a path or a query."""
    return encode(text, _KEEP_COMPONENT)


class Url(NamedTuple):
    scheme: str
    user: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.netloc}"

    @property
    def netloc(self) -> str:
        return (self.host or "") + (f":{self.port}" if self.port is not None else "")

    @property
    def href(self) -> str:
        head = f"{self.scheme}:" + ("" if self.host is None else f"//{self.user + '@' if self.user else ''}{self.netloc}")
        return head + self.path + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")

    def param(self, name: str) -> str | None:
        for pair in (self.query or "").split("&"):
            k, _, v = pair.partition("=")
            if unquote_to_bytes(k.replace("+", " ")).decode("utf-8", "replace") == name and pair:
                return unquote_to_bytes(v.replace("+", " ")).decode("utf-8", "replace")
        return None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; None if it doesn't, an error if it is out of range."""
    parts = host.removesuffix(".").split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return None
    try:
        numbers = [int(p[2:] or "0", 16) if p[:2] in ("0x", "0X") else int(p, 8 if len(p) > 1 and p[0] == "0" else 10) for p in parts]
    except ValueError as e:
        raise ValueError("bad host") from e
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("bad host")
    value = sum(n << (24 - 8 * i) for i, n in enumerate(numbers[:-1])) + numbers[-1]
    return str(ipaddress.IPv4Address(value))


def _host(raw: str, special: bool) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError("bad host")
        return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
    if not special:
        if _BAD_HOST.search(raw.replace("%", "")):
            raise ValueError("bad host")
        return encode(raw, "!\"$%&'()*+,-.;=_`{}~")
    name = unquote_to_bytes(raw).decode("utf-8", "replace")
    if not name.isascii():
        try:
            name = name.encode("idna").decode("ascii")
        except UnicodeError as e:
            raise ValueError("bad host") from e
    name = name.lower()
    if not name or _BAD_HOST.search(name):
        raise ValueError("bad host")
    return _ipv4(name) or name


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            out[-1:] = []
        elif low != ".":
            out.append(p)
        if low in (".", "..") and i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url:
    """The address of a text, relative to a base if it has no scheme. ValueError if it is none."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    rest, _, fragment = text.partition("#")
    found = encode(fragment, _KEEP_FRAGMENT) if "#" in text else None
    m = _SCHEME.match(rest)
    scheme = m[1].lower() if m else None
    if scheme is not None:
        rest = rest[m.end() :]
        if scheme in PORTS and base is not None and base.scheme == scheme and not rest[:1] in ("/", "\\"):
            scheme = None  # `http:x` is relative to an http base
    if scheme is None and base is None:
        raise ValueError("no base")
    special = (scheme or base.scheme) in PORTS
    body, _, query = rest.partition("?")
    query = encode(query, _KEEP_QUERY_SPECIAL if special else _KEEP_QUERY) if "?" in rest else None
    if special:
        body = body.replace("\\", "/")
    if scheme is None and base.host is None and not body.startswith("/"):
        if body or query is not None or found is None:
            raise ValueError("no relative address")
        return base._replace(fragment=found)
    if scheme is not None and not special and not body.startswith("/"):
        opaque = "".join(c if 32 <= ord(c) < 127 else encode(c, "") for c in body)
        return Url(scheme, "", None, None, opaque, query, found)
    user, host, port = ("", None, None) if scheme is not None else (base.user, base.host, base.port)
    if body.startswith("//") or (scheme in PORTS and scheme != "file"):
        authority, slash, tail = body.lstrip("/").partition("/") if special else body[2:].partition("/")
        body = slash + tail
        user, host, port = "", "", None
        who, at, where = authority.rpartition("@")
        if at:
            name, colon, word = who.partition(":")
            user = encode(name, _KEEP_USER) + (f":{encode(word, _KEEP_USER)}" if colon and word else "")
        m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", where)
        if not m or (not m[1] and special and (scheme or base.scheme) != "file"):
            raise ValueError("bad host")
        host = _host(m[1], special) if m[1] else ""
        if m[2]:
            port = int(m[2])
            if port > 65535:
                raise ValueError("bad port")
            port = None if port == PORTS.get(scheme or base.scheme) else port
    elif scheme == "file":
        host = ""
    elif scheme is None and not body.startswith("/"):
        if not body:
            return base._replace(query=query if query is not None else base.query, fragment=found)
        body = base.path.rpartition("/")[0] + "/" + body
    path = _dots(encode(body, _KEEP_PATH)) if body or special else ""
    return Url(scheme or base.scheme, user, host, port, path, query, found)


def try_parse(text: str | None, base: Url | None = None) -> Url | None:
    if text is None:
        return None
    try:
        return parse(text, base)
    except ValueError:
        return None
