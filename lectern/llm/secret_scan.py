"""Secrets in texts: patterns, and candidates confirmed by their structure.

Three plain patterns report what looks like a secret (an assignment to a
name such as ``password``, an access key, a long run of hex digits).  Encoded
candidates are decoded and reported only if what they hold parses:

* ``key``: base64 (plain or URL-safe, in one line or many) or hex digits that
  decode to a private key.  DER: every nested length must tile its parent,
  down to the integers of an RSA, DSA or elliptic-curve key, to a PKCS #8
  wrapping of one (also encrypted) or to a PKCS #12 store.  OpenSSH: the
  magic word, then length-prefixed fields that fill the blob exactly, with
  equal check words where it isn't encrypted.  Base64 of a whole key file is
  decoded once more.
* ``token``: a signed or encrypted compact token whose header is a JSON
  object naming an algorithm, whose payload parses, and whose signature is as
  long as that algorithm's.  Unsigned ones (``none``) are no secrets.

Public keys and certificates parse as DER but as none of these, and are left
alone.  A span covers the encoded characters, without the lines round them.

Defined cases: a null or empty text has no span; texts are scanned whole,
however long, one at a time; repeated rows get equal spans; an empty table
gives an empty table; only ``doc_id`` and ``text`` are read, so other
columns cannot clash.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lectern.llm.common import bounded_batches

KINDS = ["assign", "access", "hex", "key", "token"]     # order of spans that start together
ASSIGN_VALUE = 12       # characters of an assigned value at least

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Where an encoded structure can begin: the first bits of a DER sequence in
# base64 and in hex, of an OpenSSH key, of a key file, of a JSON object.
DER_64 = re.compile(r"M(?=[A-P][A-Za-z0-9+/_-]{22})")
DER_HEX = re.compile(r"30(?=(?:[0-7]|8[1-3])[0-9a-fA-F]{20})")
SSH_64 = re.compile(r"b3BlbnNzaC1rZXktdjE")
FILE_64 = re.compile(r"LS0tLS1CRUdJTi")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")

LINE_64 = re.compile(r"([A-Za-z0-9+/_-]+)")
BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
PADDING = re.compile(r"={0,2}")
_PLAIN = str.maketrans("-_", "+/")


# ---------------------------------------------------------------- base64

def gather(text: str, at: int, need: int | None) -> tuple[str, int]:
    """Up to ``need`` base64 characters (all: None) from ``at`` on, over line
    breaks, and where they end in the text."""
    parts, have, pos, end = [], 0, at, at
    while need is None or have < need:
        m = LINE_64.match(text, pos)
        if not m:
            break
        stop = m.end() if need is None else min(m.end(), pos + need - have)
        parts.append(text[pos:stop])
        have += stop - pos
        end = stop
        if stop < m.end():
            break
        gap = BREAK.match(text, stop)
        if not gap:
            break
        pos = gap.end()
    return "".join(parts), end


def decoded(chars: str) -> bytes:
    """Bytes of unpadded base64 in either alphabet; a lone last character is left out."""
    chars = chars[:len(chars) - (len(chars) % 4 == 1)].translate(_PLAIN)
    return base64.b64decode(chars + "=" * (-len(chars) % 4))


# ------------------------------------------------------------------- DER

def header(b: bytes, i: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the element at ``i``."""
    if i + 2 > len(b):
        return None
    tag, n = b[i], b[i + 1]
    if n < 0x80:
        return tag, i + 2, i + 2 + n
    k = n & 0x7F
    if not 1 <= k <= 4 or i + 2 + k > len(b) or b[i + 2] == 0:
        return None
    size = int.from_bytes(b[i + 2:i + 2 + k], "big")
    return (tag, i + 2 + k, i + 2 + k + size) if size >= 0x80 else None


def elements(b: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``b[begin:end]``; None if they do not fill it exactly."""
    out = []
    while begin < end:
        h = header(b, begin)
        if h is None or h[2] > end:
            return None
        out.append(h)
        begin = h[2]
    return out


# Object identifiers (content bytes).
RSA = bytes.fromhex("2a864886f70d010101")
EC = bytes.fromhex("2a8648ce3d0201")
CURVES_25519 = (bytes.fromhex("2b656e"), bytes.fromhex("2b6570"))
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
PKCS7 = bytes.fromhex("2a864886f70d0107")


def private_key(b: bytes) -> bool:
    """Whether DER bytes are a private key or a store of them, whole."""
    top = header(b, 0)
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    parts = elements(b, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    body = [b[s:e] for _, s, e in parts]
    if tags[0] == 0x02:
        if tags[:9] == [0x02] * 9 and body[0] in (b"\0", b"\1") and len(body[1]) >= 32 and tags[9:] in ([], [0x30]):
            return True                                          # RSA
        if tags == [0x02] * 6 and body[0] == b"\0" and len(body[1]) >= 32:
            return True                                          # DSA
        if tags[:2] == [0x02, 0x04] and body[0] == b"\1" and 16 <= len(body[1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
            return True                                          # elliptic curve
        if tags[:3] == [0x02, 0x30, 0x04] and body[0] in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            kind = elements(b, parts[1][1], parts[1][2])         # PKCS #8
            if not kind or kind[0][0] != 0x06:
                return False
            oid = b[kind[0][1]:kind[0][2]]
            if oid in (RSA, EC):
                return private_key(body[2])
            if oid in CURVES_25519:
                return len(body[2]) == 34 and body[2][:2] == b"\x04\x20"
            return header(body[2], 0) is not None and header(body[2], 0)[2] == len(body[2])
        if tags[:2] == [0x02, 0x30] and body[0] == b"\3" and tags[2:] in ([], [0x30]):
            kind = elements(b, parts[1][1], parts[1][2])         # PKCS #12
            return bool(kind) and kind[0][0] == 0x06 and b[kind[0][1]:kind[0][2]].startswith(PKCS7)
    if tags == [0x30, 0x04] and len(body[1]) >= 16:
        kind = elements(b, parts[0][1], parts[0][2])             # encrypted PKCS #8
        return bool(kind) and kind[0][0] == 0x06 and b[kind[0][1]:kind[0][2]].startswith(PASSWORD_BASED)
    return False


def der_size(b: bytes) -> int | None:
    """Size that the first bytes of a DER key claim; None if they can't begin one."""
    top = header(b, 0)
    if top is None or top[0] != 0x30 or top[2] < 32:
        return None
    inner = header(b, top[1])
    if inner is None or inner[2] > top[2]:
        return None
    return top[2] if inner[0] == 0x30 or (inner[0] == 0x02 and inner[2] == inner[1] + 1 and b[inner[1]] <= 3) else None


# --------------------------------------------------------------- OpenSSH

SSH_MAGIC = b"openssh-key-v1\0"


def field(b: bytes, i: int) -> tuple[bytes, int] | None:
    if i + 4 > len(b):
        return None
    end = i + 4 + int.from_bytes(b[i:i + 4], "big")
    return (b[i + 4:end], end) if end <= len(b) else None


def ssh_size(b: bytes) -> int | None:
    """Size of the OpenSSH private key that ``b`` begins with; None if its
    fields do not nest."""
    if not b.startswith(SSH_MAGIC):
        return None
    i, head = len(SSH_MAGIC), []
    for _ in range(3):                                           # cipher, key derivation, its options
        got = field(b, i)
        if got is None:
            return None
        head.append(got[0])
        i = got[1]
    if i + 4 > len(b):
        return None
    keys = int.from_bytes(b[i:i + 4], "big")
    i += 4
    if not 1 <= keys <= len(b) // 4:
        return None
    for _ in range(keys + 1):                                    # public keys, then the private part
        got = field(b, i)
        if got is None:
            return None
        i = got[1]
    secret = got[0]
    if len(secret) < 16 or (head[0] == b"none" and secret[:4] != secret[4:8]):
        return None
    return i


# ---------------------------------------------------------------- tokens

DIGEST = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}
RSA_SIGNED = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}


def _object(chars: str) -> dict | None:
    try:
        got = json.loads(decoded(chars))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed(parts: list[str]) -> bool:
    """Whether parts of a compact token have a header, payload and signature that agree."""
    head = _object(parts[0])
    alg = head.get("alg") if head else None
    if not isinstance(alg, str):
        return False
    if len(parts) == 5:                                          # encrypted: key, vector, text, tag
        return isinstance(head.get("enc"), str) and all(parts[2:]) and len(decoded(parts[4])) >= 16
    if len(parts) != 3 or not parts[2] or (head.get("zip") is None and _object(parts[1]) is None):
        return False
    size = len(decoded(parts[2]))
    if alg in RSA_SIGNED:
        return size >= 128
    return size in (64, 114) if alg == "EdDSA" else size == DIGEST.get(alg)


# ---------------------------------------------------------------- search

def _after_padding(text: str, end: int, chars: int) -> int:
    return PADDING.match(text, end, end + (-chars % 4)).end() if chars % 4 else end


def _der_64(text: str, at: int) -> int | None:
    size = der_size(decoded(gather(text, at, 32)[0]))
    if size is None:
        return None
    need = -(-size * 4 // 3)
    chars, end = gather(text, at, need)
    if len(chars) < need or not private_key(decoded(chars)[:size]):
        return None
    return _after_padding(text, end, need)


def _der_hex(text: str, at: int) -> int | None:
    size = der_size(binascii.unhexlify(text[at:at + 22]))
    if size is None or at + 2 * size > len(text):
        return None
    try:
        whole = binascii.unhexlify(text[at:at + 2 * size])
    except ValueError:          # another character in between
        return None
    return at + 2 * size if private_key(whole) else None


def _ssh_64(text: str, at: int) -> int | None:
    chars, _ = gather(text, at, None)
    size = ssh_size(decoded(chars))
    if size is None:
        return None
    need = -(-size * 4 // 3)
    return _after_padding(text, gather(text, at, need)[1], need)


def _file_64(text: str, at: int) -> int | None:
    chars, end = gather(text, at, None)
    inner = decoded(chars).decode("utf-8", "replace")
    return _after_padding(text, end, len(chars)) if any(True for _ in keys(inner, (DER_64, SSH_64))) else None


_CONFIRM = [(DER_64, _der_64), (DER_HEX, _der_hex), (SSH_64, _ssh_64), (FILE_64, _file_64)]


def keys(text: str, of=None):
    """Spans of confirmed keys.  A candidate that fails is passed by one
    character, one that is confirmed as a whole."""
    for start, confirm in _CONFIRM:
        if of is not None and start not in of:
            continue
        done = 0
        for m in start.finditer(text):
            if m.start() < done:
                continue
            end = confirm(text, m.start())
            if end is not None:
                done = end
                yield m.start(), end


def tokens(text: str):
    """Spans of confirmed tokens: the longest form (five parts, then three) that parses."""
    for m in TOKEN.finditer(text):
        parts = m.group().split(".")
        for n in (5, 3):
            if len(parts) >= n and signed(parts[:n]):
                yield m.start(), m.start() + sum(map(len, parts[:n])) + n - 1
                break


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, end, index into KINDS)`` of all secrets of a text, in order."""
    if not text:
        return []
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    out += [(*span, 3) for span in keys(text)]
    if "ey" in text or "ew" in text:
        out += [(*span, 4) for span in tokens(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, secrets`` (array of ``kind, start, end``, in order) of every row."""
    bounded_batches(docs.sparkSession)

    @arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[(KINDS[k], s, e) for s, e, k in scan(t)] for t in texts.to_pylist()], SPANS)

    return docs.select("doc_id", spans(F.col("text").cast("string")).alias("secrets"))


def listed(secrets):
    """``kind:start:end`` of an array of secrets, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
