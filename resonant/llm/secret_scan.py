"""Secret scanning with structural confirmation.

Candidates of three textual kinds are found first. Then encoded material is decoded and its structure parsed before
it is reported:

* pem: an armoured private key. Its body is one of the key layouts below, or, under the headers of a legacy encrypted
  key, whole cipher blocks for the named cipher with an initial value of its length.
* der: bare base64 or hex of a private key: PKCS#1, SEC1 and DSA by version and integers, PKCS#8 by version, algorithm
  and the key inside, encrypted PKCS#8 by its password scheme, PKCS#12 by version and content type. Every nested length
  must add up; certificates, signatures, public keys and other sequences are no secrets.
* ssh: an OpenSSH private key, all of its length-prefixed fields to the exact end.
* jwt: a token whose header is a JSON object with "alg" and whose payload is a JSON object; the signature is base64url.

A candidate that doesn't decode or parse is not reported under these kinds.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; candidates are decoded and
parsed whole, however long or deep they are; spans of several kinds at one place are all reported, by start, then kind,
then end; repeated rows are scanned each for itself; scan() returns the kept columns and spans, whatever else the table
has; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonant.llm.common import releasing

#: Kinds in the order in which spans at one start are listed: the base kinds, then the confirmed ones.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

# Fixed patterns of the base kinds; the second number is the least length of what counts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_LEAST = 12
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ACCESS_LEAST = 18
_HEX = re.compile(r"[0-9a-f]{16,}")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Z][A-Za-z-]+: [^\r\n]*)*)([A-Za-z0-9+/=\s]+?)-----END \1-----")
_DEK = re.compile(r"DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.MULTILINE)
# Block sizes of the ciphers of legacy encrypted keys, by the first part of the name.
_CIPHER_BLOCK = {"DES": 8, "RC2": 8, "BF": 8, "CAST5": 8, "IDEA": 8, "AES": 16, "CAMELLIA": 16, "ARIA": 16, "SEED": 16}
# Object identifiers as their DER content.
_RSA, _RSA_PSS = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a")
_DSA, _EC = bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
_EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_PFX_CONTENT = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")

_OPENSSH = b"openssh-key-v1\0"
_AUTHENTICATING = {b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com"}

SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def _b64(text: str, url: bool = False) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    text += "=" * (-len(text) % 4)
    try:
        return base64.b64decode(text, altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag and value range of the element at this place, if its length is well formed and stays inside."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def is_der(data: bytes) -> bool:
    """One DER sequence that fills the data, every nested length exact."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != _SEQUENCE or top[2] != len(data):
        return False
    todo = [(top[1], top[2])]
    while todo:
        at, end = todo.pop()
        while at < end:
            part = _tlv(data, at, end)
            if part is None:
                return False
            tag, start, at = part
            if tag & 0x20:
                todo.append((start, at))
    return True


def _parts(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes]]:
    """Tag and content of each element of a sequence's content; well-formed data only."""
    out = []
    end = len(data) if end is None else end
    while at < end and (part := _tlv(data, at, end)):
        out.append((part[0], data[part[1] : part[2]]))
        at = part[2]
    return out


def _is_integer(part: tuple[int, bytes]) -> bool:
    tag, body = part
    return tag == _INTEGER and len(body) > 0 and not (len(body) > 1 and (body[0] == 0 and body[1] < 128 or body[0] == 255 and body[1] >= 128))


def _inside(part: tuple[int, bytes]) -> list[tuple[int, bytes]]:
    return _parts(part[1]) if part[0] == _SEQUENCE else []


def _is_rsa(parts: list[tuple[int, bytes]]) -> bool:
    """Version 0 and eight integers, or version 1 and further primes."""
    if len(parts) < 9 or not all(map(_is_integer, parts[:9])):
        return False
    if parts[0][1] == b"\x00":
        return len(parts) == 9
    primes = _inside(parts[9]) if len(parts) == 10 and parts[0][1] == b"\x01" else []
    return bool(primes) and all(len(p := _inside(x)) == 3 and all(map(_is_integer, p)) for x in primes)


def _is_sec1(parts: list[tuple[int, bytes]]) -> bool:
    """Version 1, the private number, then at most the curve and the public point."""
    return len(parts) >= 2 and parts[0] == (_INTEGER, b"\x01") and parts[1][0] == _OCTETS and len(parts[1][1]) > 0 and [t for t, _ in parts[2:]] in ([], [0xA0], [0xA1], [0xA0, 0xA1])


def _is_pkcs8(parts: list[tuple[int, bytes]]) -> bool:
    """Version, algorithm, the key inside as its algorithm has it, then at most attributes and a public key."""
    if len(parts) < 3 or parts[0] not in ((_INTEGER, b"\x00"), (_INTEGER, b"\x01")) or parts[2][0] != _OCTETS or any(t not in (0xA0, 0x81, 0xA1) for t, _ in parts[3:]):
        return False
    algorithm, key = _inside(parts[1]), parts[2][1]
    if not algorithm or len(algorithm) > 2 or algorithm[0][0] != _OID or not algorithm[0][1] or algorithm[0][1][-1] >= 128 or not key:
        return False
    oid, top = algorithm[0][1], _tlv(key, 0, len(key))
    if oid in _EDWARDS:
        return top is not None and top[0] == _OCTETS and top[2] == len(key) and top[2] - top[1] == _EDWARDS[oid]
    if oid in (_RSA, _RSA_PSS, _EC):
        return is_der(key) and (_is_sec1 if oid == _EC else _is_rsa)(_parts(key, top[1], top[2]))
    if oid == _DSA:
        return top is not None and top[2] == len(key) and _is_integer((top[0], key[top[1] : top[2]]))
    return True


def _is_encrypted_pkcs8(parts: list[tuple[int, bytes]]) -> bool:
    algorithm = _inside(parts[0]) if len(parts) == 2 else []
    return len(algorithm) == 2 and algorithm[0][0] == _OID and algorithm[0][1].startswith(_PASSWORD_SCHEMES) and algorithm[1][0] == _SEQUENCE and parts[1][0] == _OCTETS and len(parts[1][1]) > 0


def _is_pfx(parts: list[tuple[int, bytes]]) -> bool:
    content = _inside(parts[1]) if len(parts) in (2, 3) and parts[0] == (_INTEGER, b"\x03") else []
    return len(content) == 2 and content[0][0] == _OID and content[0][1] in _PFX_CONTENT and content[1][0] == 0xA0 and all(t == _SEQUENCE for t, _ in parts[2:])


def is_private_key(data: bytes) -> bool:
    """A DER sequence laid out as a private key or a container of one."""
    if not is_der(data):
        return False
    top = _tlv(data, 0, len(data))
    parts = _parts(data, top[1], top[2])
    dsa = len(parts) == 6 and all(map(_is_integer, parts)) and parts[0][1] == b"\x00"
    return dsa or _is_rsa(parts) or _is_sec1(parts) or _is_pkcs8(parts) or _is_encrypted_pkcs8(parts) or _is_pfx(parts)


def _fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from this place on, all or so many, and where they end; None if one does not stay inside."""
    out: list[bytes] = []
    while at < len(data) if most is None else len(out) < most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, at


def _is_openssh_key(data: bytes) -> bool:
    """Cipher, key derivation and its options, a count, so many public keys and the private part, to the exact end; after the
    private part an authenticating cipher has its tag of 16 bytes."""
    head = _fields(data, len(_OPENSSH), 3)
    if head is None:
        return False
    (cipher, kdf, options), at = head
    count = int.from_bytes(data[at : at + 4], "big")
    body = _fields(data, at + 4, count + 1) if count else None
    if body is None or not cipher or not kdf or (kdf == b"none") != (cipher == b"none") or (kdf == b"none" and options):
        return False
    (*public, private), at = body
    if any(len((_fields(key) or ([], 0))[0]) < 2 for key in public):
        return False
    if cipher == b"none" and (len(private) < 8 or private[:4] != private[4:8]):
        return False
    return bool(private) and len(data) - at == (16 if cipher in _AUTHENTICATING else 0)


def is_ssh_blob(data: bytes) -> bool:
    """The body of an OpenSSH private key file."""
    return data.startswith(_OPENSSH) and _is_openssh_key(data)


def is_signed_token(text: str) -> bool:
    """Three base64url parts of which the first is a JSON object with a string "alg" and the second a JSON object; only an
    unsigned token has no third part."""
    parts = text.split(".")
    try:
        header, payload = (json.loads(_b64(p, url=True) or b"") for p in parts[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)):
        return False
    return bool(_b64(parts[2], url=True)) != (header["alg"].lower() == "none")


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_blob(data) else "der" if is_private_key(data) else None


def _is_armoured_key(headers: str, body: str) -> bool:
    data = _b64(body)
    if "Proc-Type: 4,ENCRYPTED" not in headers:
        return _key_kind(data) is not None
    dek = _DEK.search(headers)
    block = _CIPHER_BLOCK.get(dek[1].split("-")[0]) if dek else None
    return bool(data) and block is not None and len(data) % block == 0 and len(dek[2]) == 2 * block


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if _is_armoured_key(m[2], m[3])]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    for m in _BASE64.finditer(text):
        if kind := _key_kind(_b64(m[0])):
            found.append((kind, *m.span()))
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((kind, *m.span()))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        names = batch.schema.names
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column(names.index("__text")).to_pylist()]
        keep = [(n, batch.column(i)) for i, n in enumerate(names) if n != "__text"]
        yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(spans, pa.list_(item))], names=[n for n, _ in keep] + ["spans"])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans, an array of (kind, start, end), of every row."""
    from pyspark.sql import types as T

    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    out = T.StructType([source.schema[c] for c in keep] + [T.StructField("spans", T._parse_datatype_string(SPAN_TYPE))])
    return source.mapInArrow(releasing(_scan_batches), out)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by the mask."""
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin("assign", "access", "hex"))).cast("long").alias("n_confirmed"),
    )


def base_digest(text: str | None) -> str:
    """The digest of one text's base spans, for tests."""
    spans = [f"{k}:{a}:{b}" for k, a, b in find_spans(text) if k in KINDS[:3]]
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
