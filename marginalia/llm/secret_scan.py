"""Secret scans with structural confirmation.

Base patterns report assignments, access keys and hex runs. Above them, candidates in base64 (plain, URL-safe, or in a
PEM block) and hex are decoded and parsed: DER private keys must have nested lengths that fit exactly, OpenSSH keys
length-prefixed fields that fit, and signed tokens a JSON header that names an algorithm. Only what parses is added.

Null and empty texts give no spans. Spans are of code points, end exclusive, over the whole text; a base span is never
dropped. Ties in start are ordered by kind. Other columns of the input are ignored; repeated rows are scanned alike.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex", "key", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"assw|secret|token|api", re.A | re.I)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{44,}={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
# at the first eyJ of a run of such characters only, as a later one would end alike
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")


def decode64(text: str) -> bytes | None:
    """Base64 or its URL-safe form, with white space and without padding allowed; None if it isn't."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill data exactly; None if lengths don't fit."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or i + wide > len(data):
                return None
            n = int.from_bytes(data[i : i + wide], "big")
            i += wide
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#1 (nine integers), PKCS#8 (version, algorithm, octets) or SEC1 (version, octets, tags)."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(top[0][1])
    if not inner or inner[0][0] != 2 or len(inner[0][1]) != 1:
        return False
    tags = [t for t, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return True
    if len(tags) >= 3 and tags[1:3] == [0x30, 4]:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    return len(tags) >= 2 and tags[1] == 4 and inner[0][1] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then cipher, derivation and options as length-prefixed fields, and a count."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    i = len(magic)
    for _ in range(3):
        if i + 4 > len(data):
            return False
        n = int.from_bytes(data[i : i + 4], "big")
        i += 4 + n
        if n > 256 or i > len(data):
            return False
    return i + 4 <= len(data) and 1 <= int.from_bytes(data[i : i + 4], "big") <= 64


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_signed_token(text: str) -> bool:
    """Whether the first of three dotted parts is a JSON object with a string `alg`, and the second a JSON object."""
    head, body, _ = text.split(".")
    try:
        head, body = (json.loads(decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind in KINDS, end), sorted."""
    found = []
    if _WORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    keys = []
    if "-----BEGIN " in text:
        keys = [m.span() for m in _PEM.finditer(text) if is_key(decode64(m[2]))]
    keys += [m.span() for m in _BASE64.finditer(text) if is_key(decode64(m[0])) and not any(s <= m.start() < e for s, e in keys)]
    keys += [m.span() for m in _ANY_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    found += {(s, 3, e) for s, e in keys}
    if "eyJ" in text:
        found += [(m.start(1), 4, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[1])]
    return sorted(found)


def _kernel(texts: list[str]) -> list[list]:
    return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] for t in texts]]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and secrets, an array of (kind, start, end) sorted by start, then kind in the order of KINDS."""
    return common.map_texts(df, _kernel, "secrets array<struct<kind: string, start: int, `end`: int>>", key, text)
