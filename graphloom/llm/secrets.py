"""Secret scan with structural confirmation (operator 4).

Base patterns (``assign``, ``access``, ``hex``) are always reported. On top of them, base64 and hex candidates are decoded and
reported only if what they decode to is well-formed: a signed token whose header and payload are JSON objects (``jwt``), an armoured
private key (``pem``; line breaks may be escaped, encrypted keys must name their cipher and start value), or a bare key encoding (``der``)
whose tag-length-value structure nests without a byte left over.

Defined results: spans that start together stand in the order of their kinds, then by their end; a null text is an empty text; an empty table gives no rows; repeated rows give repeated results; other columns of
the input are ignored. Every scan is linear in the text, whatever its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, sha256_hex, small_batches, spans_text

KINDS = ("assign", "access", "hex", "jwt", "pem", "der")
BASE = KINDS[:3]
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
BEGIN, END = (re.compile(rf"-----{x} ((?:[A-Z0-9]{{1,20}} ){{0,4}}PRIVATE KEY)-----") for x in ("BEGIN", "END"))
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: Every base or added span holds such a run, but for assignments, signed tokens of short parts and keys wrapped in short lines.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def tlv(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The (tag, from, to) items that fill data[start:end] exactly; None if they don't. Constructed items must nest well."""
    items = []
    while start < end:
        if start + 2 > end or depth > 12:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end or not data[start]:
                return None
            size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if start + size > end or (tag & 0x20 and tlv(data, start, start + size, depth + 1) is None):
            return None
        items.append((tag, start, start + size))
        start += size
    return items


def ssh_container(data: bytes) -> bool:
    """An OpenSSH private key container: magic, cipher, kdf, options, key count, then that many length-prefixed public keys and the secret part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> int | None:
        nonlocal at
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        at += 4 + n
        return n

    if not field() or not field() or field() is None or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys + 1)) and at == len(data)


def key_encoding(data: bytes) -> str | None:
    """The kind of private key that the bytes encode, or None."""
    if ssh_container(data):
        return "openssh"
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = tlv(data, 0, len(data))
    if not top or len(top) != 1:
        return None
    inner = tlv(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in inner]
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = tlv(data, inner[1][1], inner[1][2]) or []
        return "pkcs8" if algorithm and algorithm[0][0] == 0x06 else None
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return "rsa"
    if len(tags) == 6 and set(tags) == {0x02}:
        return "dsa"
    if tags[:2] == [0x02, 0x04] and data[inner[0][1] : inner[0][2]] == b"\x01":
        return "ec"
    if tags == [0x30, 0x04]:  # encrypted: algorithm and octets
        algorithm = tlv(data, inner[0][1], inner[0][2]) or []
        return "encrypted" if algorithm and algorithm[0][0] == 0x06 else None
    return None


def armoured(body: str) -> bool:
    """Whether the text between the marks is a key: header lines, an empty line, base64; line breaks may be escaped."""
    lines, headers = body.replace("\\r", "").replace("\\n", "\n").strip().splitlines(), {}
    while lines and ":" in lines[0]:
        name, _, value = lines.pop(0).partition(":")
        headers[name.strip()] = value.strip()
    data = from_base64("".join(lines))
    if not data:
        return False
    if headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED":
        cipher, _, start = headers.get("DEK-Info", "").partition(",")
        return len(data) % 8 == 0 and bool(re.fullmatch(r"[A-Z0-9-]+", cipher.strip()) and re.fullmatch(r"(?:[0-9A-Fa-f]{16}){1,2}", start.strip()))
    return key_encoding(data) is not None


def armoured_keys(text: str) -> list[tuple[str, int, int]]:
    """From each opening mark to the next closing one, if no other mark opens between them and both name one kind of key."""
    begins, ends, out = list(BEGIN.finditer(text)), list(END.finditer(text)), []
    starts = [m.start() for m in ends]
    for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)], strict=True):
        k = bisect_left(starts, m.end())
        if k < len(ends) and starts[k] < after and ends[k][1] == m[1] and armoured(text[m.end() : starts[k]]):
            out.append(("pem", m.start(), ends[k].end()))
    return out


def from_base64(s: str) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(s: str) -> dict | None:
    data = from_base64(s)
    try:
        found = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(s: str) -> bool:
    header, payload, signature = s.split(".")
    head = json_object(header)
    return bool(head) and isinstance(head.get("alg"), str) and json_object(payload) is not None and from_base64(signature) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure proves them; one inside another of these is left out."""
    out = [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if signed_token(m[0])]
    if "-----BEGIN" in text:
        out += armoured_keys(text)
    for m in BASE64.finditer(text):
        if (data := from_base64(m[0])) and key_encoding(data):
            out.append(("der", m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and key_encoding(bytes.fromhex(m[0])):
            out.append(("der", m.start(), m.end()))
    kept, reach = [], -1
    for span in sorted(set(out), key=lambda s: (s[1], -s[2])):
        if span[2] > reach:
            kept.append(span)
            reach = span[2]
    return kept


def assigns(low: str) -> bool:
    return "passw" in low or "secret" in low or "token" in low or "api" in low


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if not text or not (RUN.search(text) or "eyJ" in text or "-----BEGIN" in text or assigns(text.lower())):
        return [], []
    by = lambda s: (s[1], ORDER[s[0]], s[2])
    base = sorted(base_spans(text), key=by)
    return base, sorted(base + confirmed_spans(text), key=by)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [scan(t) for t in piece.column(1).to_pylist()]
            n = [[sum(s[0] == k for s in base) for base, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array([sha256_hex(spans_text(b)) for b, _ in found], pa.string()), pa.array([spans_text(a) for _, a in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
