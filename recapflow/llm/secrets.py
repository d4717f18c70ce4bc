"""Secrets in texts, confirmed by structure.

Three base patterns give candidates by shape. The structural scan then looks at every run of base64 or hex characters
that could hold a key, wherever in the run it starts, decodes it and reports it only if the bytes parse: DER structures whose nested lengths fill each
other and whose content has the layout of a private or a public key, OpenSSH keys whose length fields fill the blob, and signed tokens
whose header is a JSON object that names its algorithm. Runs may be wrapped at any width, behind comment marks and in
joined string literals; hex also with colons. Signatures, digests and certificates have other layouts and give no span. Base spans are never removed.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns. Letters of the names match in either case, ASCII only.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Kinds in the order in which spans with the same start are listed: base kinds, then those of the structural scan.
KINDS = ("assign", "access", "hex", "private_key", "public_key", "ssh_key", "signed_token")
BASE_KINDS = KINDS[:3]

#: The smallest key: SEC1 on a curve of 192 bits without parameters.
_DER_MIN = 31
_BASE64 = "[A-Za-z0-9+/_-]"
_LINE_END = r"(?:\r\n?|\n|\\+(?:r\\+)?n)"
#: What may stand between two lines of base64 or hex: a line end, real or escaped, with blanks, quotes, a joining sign and a
#: comment mark around it; or the end of a string literal and the start of the next.
BREAK = re.compile(
    rf"""(?:\\+(?:r\\+)?n)?(?:["'][ \t]*[+.,\\]?|[ \t]+\\)?[ \t]*{_LINE_END}[ \t]*(?:[#*>;%|]+[ \t]*)?(?:[+.][ \t]+)?["']?|["'][ \t]*[+.]?[ \t]*["']"""
)
BASE64_RUN = re.compile(rf"{_BASE64}{{16,}}(?:(?:{BREAK.pattern}){_BASE64}+)*={{0,2}}")
#: Where a key may start in a run: a DER sequence of _DER_MIN bytes or more, OpenSSH's magic.
KEY_START = re.compile("M[B-I]|b3BlbnNzaC1rZXktdjEA")
_HEX = "[0-9A-Fa-f]"
HEX_RUN = re.compile(rf"{_HEX}{{16,}}(?:(?:{BREAK.pattern}){_HEX}+)*|(?:{_HEX}{{2}}:(?:{BREAK.pattern})?){{8,}}{_HEX}{{2}}")
HEX_PART = re.compile(rf"{BREAK.pattern}|:")
HEX_START = re.compile("(?=30(?:[1-7]|8[1-4]))|(?=6f70656e7373682d6b65792d763100)")
#: Algorithms that encrypt a private key: PKCS#5 and PKCS#12 password encryption.
_PASSWORD_OIDS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
#: The least bits of a modulus, the most of a public exponent.
_MODULUS, _EXPONENT = 512, 64
#: A header starts with a brace, or with white space before it; looked ahead, so that no match hides a later one.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=((?:e[wy]|[CDI])[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
_SSH_MAGIC = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points. A match that fails its length rule is used up, not searched again."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the DER element at ``at``, if its length fits into ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            return None  # DER writes lengths in the shortest form
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start..end exactly."""
    out = []
    while start < end:
        x = der(data, start, end)
        if x is None:
            return None
        out.append(x)
        start = x[2]
    return out


def der_kind(data: bytes) -> str | None:
    """``private_key`` for the layouts PKCS#1, PKCS#8 (plain or encrypted), SEC1 and old-style DSA, ``public_key`` for PKCS#1 and
    SubjectPublicKeyInfo, else nothing. Two integers alone are a key only as a modulus and an exponent, not as a signature."""
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or len(data) < _DER_MIN:
        return None
    parts = _children(data, top[1], top[2])
    if not parts:
        return None
    tags = [p[0] for p in parts]

    def content(k: int) -> bytes:
        return data[parts[k][1]:parts[k][2]]

    def algorithm(k: int) -> bytes:
        """Object id of the algorithm in the ``k``-th part."""
        inner = _children(data, parts[k][1], parts[k][2]) if tags[k] == 0x30 else None
        return data[inner[0][1]:inner[0][2]] if inner and inner[0][0] == 0x06 else b""

    def bits(k: int) -> int:
        return int.from_bytes(content(k), "big", signed=True).bit_length() if parts[k][2] > parts[k][1] else 0

    if all(t == 0x02 for t in tags):
        if len(parts) in (9, 10) and content(0) in (b"\0", b"\1"):
            return "private_key"  # PKCS#1
        if len(parts) == 6 and content(0) == b"\0" and bits(1) >= _MODULUS:
            return "private_key"  # DSA
        odd = len(parts) == 2 and bits(0) >= _MODULUS and data[parts[0][1]] < 0x80 and content(0)[-1] & 1
        return "public_key" if odd and 1 < bits(1) <= _EXPONENT and content(1)[-1] & 1 and content(1)[0] < 0x80 else None
    if tags == [0x02] * 9 + [0x30] and content(0) == b"\1":
        return "private_key"  # PKCS#1 with further primes
    if tags[:3] == [0x02, 0x30, 0x04] and content(0) in (b"\0", b"\1") and algorithm(1) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return "private_key"  # PKCS#8
    if tags == [0x30, 0x04] and algorithm(0).startswith(_PASSWORD_OIDS):
        return "private_key"  # encrypted PKCS#8
    if tags == [0x30, 0x03] and algorithm(0) and content(1)[:1] == b"\0" and len(content(1)) > 32:
        return "public_key"  # SubjectPublicKeyInfo
    if tags[:2] == [0x02, 0x04] and content(0) == b"\1" and len(content(1)) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "private_key"  # SEC1
    return None


def ssh_end(data: bytes) -> int | None:
    """Where an openssh-key-v1 blob ends by its own length fields, if they all fit."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def skip(fields: int) -> bool:
        nonlocal at
        for _ in range(fields):
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 > len(data) or at + 4 + size > len(data):
                return False
            at += 4 + size
        return True

    if not skip(3) or at + 4 > len(data):  # cipher, derivation, its options
        return None
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return at if keys >= 1 and skip(keys + 1) else None  # every field takes four bytes, so the blob bounds the count


def _unpadded(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    s = s[:-1] if len(s) % 4 == 1 and not url else s
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(s + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str) -> bool:
    """The header is a JSON object with an algorithm, and the body decodes."""
    raw = _unpadded(head, url=True)
    try:
        header = json.loads(raw.decode("utf-8")) if raw is not None else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and _unpadded(body, url=True) is not None


def _key_at(data: bytes, first: int) -> tuple[int | None, str | None]:
    """Bytes and kind of the structure at ``first``; one that is no key, a certificate say, is not searched for keys inside."""
    if data.startswith(_SSH_MAGIC, first):
        return ssh_end(data[first:]), "ssh_key"
    top = der(data, first, len(data))
    if not top or top[0] != 0x30 or top[2] == top[1] or data[top[1]] not in (0x02, 0x30) or not _children(data, top[1], top[2]):
        return None, None
    return top[2] - first, der_kind(data[first:top[2]])


def _run_keys(m: re.Match, breaks: re.Pattern, starts: re.Pattern, unit: int, decode) -> Iterator[tuple[int, int, str]]:
    """Keys in a run of base64 or hex, wherever they start in it. Breaks are dropped for decoding; places are those of the
    text. ``decode`` turns whole groups of ``unit`` characters into ``per`` bytes each, so ``unit`` decodings serve all starts."""
    run = m[0].rstrip("=")
    lines, inner, outer, n, at = [], [], [], 0, 0
    for stop, after in [*((b.start(), b.end()) for b in breaks.finditer(run)), (len(run), len(run))]:
        lines.append(run[at:stop])
        inner.append(n)
        outer.append(m.start() + at)
        n, at = n + stop - at, after
    per = 3 if unit == 4 else 1
    if n * per < _DER_MIN * unit:
        return
    flat = "".join(lines)
    flat = flat.replace("-", "+").replace("_", "/") if unit == 4 else flat.lower()
    bytes_of: dict[int, bytes] = {}

    def place(k: int) -> int:
        line = bisect.bisect_right(inner, k) - 1
        return outer[line] + k - inner[line]

    at = 0
    while k := starts.search(flat, at):
        phase, at = k.start() % unit, k.start() + 1
        if phase not in bytes_of:
            bytes_of[phase] = decode(flat[phase:]) or b""
        size, kind = _key_at(bytes_of[phase], (k.start() - phase) // unit * per)
        if not size:
            continue
        # the key ends where its outermost length says; what the run swallowed behind it is not part of the span
        at = k.start() + -(-size * unit // per)
        end = place(at - 1) + 1
        while unit == 4 and end < m.end() and m.string[end] == "=":
            end += 1
        if kind:
            yield place(k.start()), end, kind


def _unhexed(s: str) -> bytes:
    return bytes.fromhex(s[:len(s) // 2 * 2])


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in TOKEN.finditer(text):
        if is_signed_token(m[1], m[2]) and not (out and m.start() < out[-1][1]):
            out.append((m.start(), m.end(3), "signed_token"))
    for m in BASE64_RUN.finditer(text):
        out.extend(_run_keys(m, BREAK, KEY_START, 4, _unpadded))
    for m in HEX_RUN.finditer(text):
        out.extend(_run_keys(m, HEX_PART, HEX_START, 2, _unhexed))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_structural, base_sha256 and spans.

    Spans are ``kind:start:end`` in code points, end exclusive. NULL and empty texts have none; repeated rows are
    scanned each; other columns are not read; an empty table gives an empty table. Texts are scanned whole and nothing
    is shuffled."""
    names = [id, "n_assign", "n_access", "n_hex", "n_structural", "base_sha256", "spans"]
    kinds = [docs.schema[id].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                t = x.as_py() or ""
                base, more = base_spans(t), structural_spans(t)
                n = [sum(s[2] == k for s in base) for k in BASE_KINDS]
                rows.append((*n, len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=names)

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)
