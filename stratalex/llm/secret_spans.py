"""Secret scans: three base patterns, and candidates confirmed by their structure.

A base64 or hex run, an armoured key block or a dotted token is only a candidate: it is decoded and its structure is
parsed before it is reported. Confirmed kinds, after the base kinds ``assign``, ``access`` and ``hex``:

- ``pem``: BEGIN/END armour of a private key whose body decodes to DER with nested lengths that fit exactly, to the
  binary form of an OpenSSH key, or to an encrypted body under its headers;
- ``der``: base64 or hex in which a DER private key begins (a sequence that starts with a version); its own nested
  lengths say where it ends, whatever characters of the same alphabet stand before or after it;
- ``ssh``: base64 in which an OpenSSH private key begins (magic and length-prefixed fields), up to where they end;
- ``jwt``: header.payload.signature, the first two base64url JSON objects, the header naming an algorithm;
- ``basic``: base64 of ``user:password`` after ``Basic`` in an authorization header.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ["assign", "access", "hex", "pem", "der", "ssh", "jwt", "basic"]
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run that fails the length test leaves no longer run inside it, so the least lengths can stand in the patterns
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----")
_LINE_END = re.compile(rb"(?:\\r)?\\n|\r?\n")
# lines of 40 characters or more, then perhaps the shorter last line of a wrapped run
_BLOB = re.compile(rb"(?:[A-Za-z0-9+/]{40,}(?:\r?\n)?)+(?:(?<=\n)[A-Za-z0-9+/]{1,39}={0,2}|={0,2})")
_HEXES = re.compile(rb"[0-9a-fA-F]{60,}")
_BREAK = re.compile(rb"\r?\n")
# how keys begin in binary: a sequence of 32 bytes or more that opens with a version or with another sequence; a magic
_KEY = re.compile(rb"\x30(?:\x82..|\x81.|\x83...|[\x20-\x7f])(?=\x02\x01[\x00\x01]|\x30)|openssh-key-v1\x00", re.S)
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})")
_BASIC = re.compile(rb"""(?i:authorization["']?[\x20\t]*[:=][\x20\t]*["']?basic)\x20+([A-Za-z0-9+/]{8,}={0,2})""")
Span = tuple[str, int, int]


def decoded64(data: bytes, url: bool = False) -> bytes | None:
    data = b"".join(data.split()).rstrip(b"=")
    if url:
        data = data.translate(bytes.maketrans(b"-_", b"+/"))
    if len(data) % 4 == 1:
        return None
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER items that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80 or n < 1 << 8 * (k - 1):
                return None
            at += k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, SEC1 or PKCS#8: a sequence of a small version and the rest of a private key, or an encrypted one."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x02 and items[0][1] in (b"\0", b"\1"):
        if tags[1:9] == [0x02] * 8 or tags[1] == 0x04 or tags[1:6] == [0x02] * 5:
            return all(v for _, v in items[1:])
        return tags[1:3] == [0x30, 0x04] and bool(inner := der_items(items[1][1])) and inner[0][0] == 0x06
    if tags == [0x30, 0x04]:
        inner = der_items(items[0][1])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][1][:5] == b"\x2a\x86\x48\x86\xf7"
    return False


def is_ssh_key(data: bytes) -> bool:
    """The magic, then cipher, kdf and options as length-prefixed strings, then a number of keys and a public key."""
    if data[:15] != b"openssh-key-v1\0":
        return False
    at = 15
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if n > 4096 or at > len(data):
            return False
    keys = int.from_bytes(data[at : at + 4], "big")
    n = int.from_bytes(data[at + 4 : at + 8], "big")
    return 1 <= keys <= 16 and 0 < n and at + 8 + n <= len(data)


def ssh_end(data: bytes) -> int | None:
    """Where an OpenSSH key ends: behind its public keys and its private section, if ``data`` holds them whole."""
    at = 15
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def keys_in(data: bytes, step: int) -> Iterator[tuple[str, int, int]]:
    """Kinds, starts and ends of the private keys that begin at multiples of ``step`` in ``data``. An OpenSSH key that is cut
    off goes on to the end."""
    after = 0
    for m in _KEY.finditer(data):
        at = m.start()
        if at < after or at % step:
            continue
        if data[at] == 0x30:
            size = data[at + 1]
            head = 2 + (size & 0x7F if size & 0x80 else 0)
            end = at + head + (int.from_bytes(data[at + 2 : at + head], "big") if size & 0x80 else size)
            kind = "der" if end <= len(data) and is_private_der(data[at:end]) else None
        else:
            kind = "ssh" if is_ssh_key(data[at:]) else None
            end = at + (ssh_end(data[at:]) or len(data) - at) if kind else at
        if kind:
            yield kind, at, end
            after = end


def is_private_key(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private_der(data) else "ssh" if is_ssh_key(data) else None


def _json(data: bytes | None) -> dict | None:
    try:
        got = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def base_spans(text: bytes) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def armoured(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and body of each block from a BEGIN line to its END line. A BEGIN line whose END line does not come before
    the next BEGIN line of a key opens nothing, so every byte is searched once."""
    heads = list(_PEM.finditer(text))
    for i, m in enumerate(heads):
        mark = b"-----END " + m[1] + b"-----"
        at = text.find(mark, m.end(), heads[i + 1].start() if i + 1 < len(heads) else len(text))
        if at >= 0:
            yield m.start(), at + len(mark), text[m.end() : at]


def unarmoured(body: bytes) -> tuple[bytes, bytes]:
    """The header lines of an armoured body and what follows them; line ends may be escaped."""
    lines = _LINE_END.split(body)
    n = max((i + 1 for i, line in enumerate(lines) if b":" in line), default=0)
    return b"\n".join(lines[:n]), b"\n".join(lines[n:])


def confirmed_spans(text: bytes) -> list[Span]:
    out: list[Span] = []
    if b"-----BEGIN" in text:
        for start, end, body in armoured(text):
            headers, plain = unarmoured(body)
            data = decoded64(plain)
            if is_private_key(data) or (data and len(data) >= 32 and b"ENCRYPTED" in headers and len(data) % 8 == 0):
                out.append(("pem", start, end))
    if b"eyJ" in text:
        for m in _JWT.finditer(text):
            head, load = _json(decoded64(m[1], True)), _json(decoded64(m[2], True))
            if head and isinstance(head.get("alg"), str) and load is not None and decoded64(m[3], True):
                out.append(("jwt", m.start(), m.end()))
    if b"asic " in text or b"ASIC " in text:
        for m in _BASIC.finditer(text):
            data = decoded64(m[1])
            if data and 3 <= len(data) and b":" in data[1:-1] and all(32 <= c < 127 for c in data):
                out.append(("basic", m.start(1), m.end(1)))
    armour = [(a, b) for k, a, b in out if k == "pem"]
    runs = [s for m in _BLOB.finditer(text) for s in keys_of_base64(m[0], m.start())]
    runs += [s for m in _HEXES.finditer(text) for s in keys_of_hex(m[0], m.start())]
    return out + [s for s in runs if not any(a <= s[1] < b for a, b in armour)]


def keys_of_base64(run: bytes, offset: int) -> Iterator[Span]:
    """Keys in a run of base64, which may be wrapped and may have begun before the key: a key starts with any character, so
    the run is decoded from each of four. A span takes in padding, and the line end that a key's last line has in the run."""
    plain = _BREAK.sub(b"", run).rstrip(b"=")
    if not any(mark in plain for mark in (b"M", b"b3Blbn")):
        return
    wraps = [m.span() for m in _BREAK.finditer(run)]
    # characters of ``plain`` before each line end, and where the next line begins
    before, gone = [], 0
    for a, b in wraps:
        before.append(a - gone)
        gone += b - a
    place = lambda i: i + sum(b - a for (a, b), n in zip(wraps, before) if n <= i) if wraps else i
    found: list[tuple[int, int, str]] = []
    for shift in range(4):
        part = plain[shift:]
        data = base64.b64decode(part[: len(part) // 4 * 4] if len(part) % 4 == 1 else part + b"=" * (-len(part) % 4))
        found += [(shift + a // 3 * 4, shift + -(-b * 4 // 3), kind) for kind, a, b in keys_in(data, 3)]
    after = 0
    for a, b, kind in sorted(found):
        if a >= after:
            end = place(b - 1) + 1
            end += len(run[end:].rstrip(b"\r\n")) if b == len(plain) else 0  # padding, perhaps on a line of its own
            wrap = _BREAK.match(run, end)
            yield kind, offset + place(a), offset + (wrap.end() if wrap else end)
            after = b


def keys_of_hex(run: bytes, offset: int) -> Iterator[Span]:
    """Keys in a run of hexadecimal digits, from either of the first two."""
    found = []
    for shift in range(2):
        part = run[shift:]
        data = bytes.fromhex(part[: len(part) // 2 * 2].decode())
        found += [(offset + shift + 2 * a, offset + shift + 2 * b, kind) for kind, a, b in keys_in(data, 1)]
    after = 0
    for a, b, kind in sorted(found):
        if a >= after:
            yield kind, a, b
            after = b


def spans_of(text: bytes) -> list[Span]:
    """All spans, by start and then by kind, in code points with the end exclusive."""
    found = base_spans(text) + confirmed_spans(text)
    if not found:
        return found
    if not text.isascii():
        starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        before = np.r_[0, np.cumsum(starts)]
        found = [(k, int(before[a]), int(before[b])) for k, a, b in found]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    A null text is empty and has no spans; base_sha256 is then the digest of the empty string. Matches that overlap are
    all reported. Texts and keys of any length are read whole. Repeated rows get a row each; other columns are not read; an
    empty table gives no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for t in p.bytes:
                found = spans_of(t)
                base = [s for s in found if s[0] in KINDS[:3]]
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), sha256(joined(base).encode()).hexdigest(), joined(found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]).assign(doc_id=p.doc_id.to_numpy())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        lean(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
        .mapInPandas(run, f"n_assign long, n_access long, n_hex long, base_sha256 string, spans string, doc_id {kind}")
        .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` (overlapping ones together) replaced by ``mark``, and ``n_chars``, if there is
    such a column, the length of what is left. Null texts stay null; all rows and columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = spans_of(t.encode()) if t else []
            parts, at = [], 0
            for _, a, b in spans:
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pd.Series(out, dtype=object)

    rows = lean(docs).withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows
