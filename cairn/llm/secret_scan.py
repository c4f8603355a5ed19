"""Secrets: fixed patterns, and encoded keys and tokens that are reported only once their structure is confirmed.

The fixed patterns (assignments, access keys, long hex) are told as they match. Beside them, every run of base64 or hex,
also one that is wrapped over lines or stands between PEM marks, is decoded and read as what it could be: a private key
in DER (PKCS #1, PKCS #8 plain and encrypted, SEC 1, DSA), an OpenSSH key, OpenPGP key packets, or a signed token whose
header names its algorithm. Nested lengths must fill their frame to the last byte, so random runs are not reported. What
decodes to text is searched again, to NESTED levels.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: In the order in which spans of equal start are told; the first three are those of the fixed patterns.
KINDS = ("assign", "access", "hex", "key", "token")
#: Kind, pattern, group that is measured, least length of it.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Levels of encoding within encoding that are opened.
NESTED = 3
#: Characters of the shortest run that is decoded: no private key is shorter.
LEAST_RUN = 40
BREAK = re.compile(r"\r?\n[\x20\t]*|\\n")
#: Runs start where no run goes on, and are possessive: the search stays linear.
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+(?:(?:\r?\n[\x20\t]*+|\\n)[A-Za-z0-9+/_-]++)*+")
HEX_RUN = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{LEAST_RUN},}}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
PEM_HEADER = re.compile(r"[A-Za-z-]+: [^\n]*")
#: Bytes of the signature by algorithm (RFC 7518, RFC 8037); RSA signatures are as long as the key.
SIGNED = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}
RSA_SIGNED, RSA_BYTES = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}, range(128, 2049)
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
RSA, EC, CURVES, PASSWORDS = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), (bytes.fromhex("2b656e"), bytes.fromhex("2b656f"), bytes.fromhex("2b6570"), bytes.fromhex("2b6571")), (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SPANS = "array<struct<kind: string, start: int, end: int, detail: string, value: string>>"


def tlv(b: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at ``at``; None unless its length fits the bytes."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        width, n = n & 0x7F, int.from_bytes(b[at : at + (n & 0x7F)], "big")
        at += width
        if not 1 <= width <= 4 or n < 0x80:  # indefinite, or longer than need be
            return None
    return (tag, at, at + n) if at + n <= len(b) else None


def parts(b: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``b`` to the last byte, or None."""
    at, out = 0, []
    while at < len(b):
        x = tlv(b, at)
        if not x:
            return None
        out.append((x[0], b[x[1] : x[2]]))
        at = x[2]
    return out


def der_key(b: bytes) -> tuple[int, str] | None:
    """(bytes taken, form) of the private key at the start of ``b``."""
    x = tlv(b, 0)
    inner = parts(b[x[1] : x[2]]) if x and x[0] == SEQUENCE else None
    if not inner:
        return None
    tags, first = [t for t, _ in inner], inner[0][1]
    form = None
    if tags[:2] == [INTEGER, SEQUENCE] and tags[2:3] == [OCTETS] and first in (b"\0", b"\1") and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        named, key = parts(inner[1][1]), inner[2][1]
        oid = named[0][1] if named and named[0][0] == OID else b""
        nested = der_key(key)
        fits = bool(nested) and nested[0] == len(key)
        if oid == RSA and fits and nested[1] == "pkcs1" or oid == EC and fits and nested[1] == "sec1":
            form = "pkcs8"
        elif oid in CURVES and (seed := parts(key)) and len(seed) == 1 and seed[0][0] == OCTETS and len(seed[0][1]) in (32, 56, 57):
            form = "pkcs8"
        elif oid and oid not in (RSA, EC, *CURVES) and (other := parts(key)) and len(other) == 1:
            form = "pkcs8"
    elif len(tags) >= 9 and tags[:9] == [INTEGER] * 9 and first in (b"\0", b"\1") and tags[9:] == [SEQUENCE] * (first == b"\1"):
        form = "pkcs1" if min(len(v) for _, v in inner[1:]) > 0 and len(inner[1][1]) >= 2 * min(len(inner[4][1]), len(inner[5][1])) - 4 else None
    elif tags == [INTEGER] * 6 and first == b"\0" and len(inner[1][1]) >= 64:
        form = "dsa"
    elif tags[:2] == [INTEGER, OCTETS] and first == b"\1" and 14 <= len(inner[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        params = [parts(v) for _, v in inner[2:]]
        form = "sec1" if all(p and len(p) == 1 and p[0][0] in (OID, SEQUENCE, BITS) for p in params) else None
    elif tags == [SEQUENCE, OCTETS] and len(inner[1][1]) >= 16:
        named = parts(first)
        form = "pkcs8-encrypted" if named and named[0][0] == OID and named[0][1].startswith(PASSWORDS) else None
    return (x[2], form) if form else None


def openssh_key(b: bytes) -> tuple[int, str] | None:
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return None
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + n > len(b):
            return None
        at += 4 + n
        return b[at - n : at]

    head = [field(), field(), field()]
    keys = int.from_bytes(b[at : at + 4], "big")
    at += 4
    if None in head or not head[0] or not 1 <= keys <= 64:
        return None
    for _ in range(keys):
        public = field()
        if not public or not 1 <= int.from_bytes(public[:4], "big") <= len(public) - 4:
            return None
    secret = field()
    if not secret or len(secret) % 8 or head[0] == b"none" and secret[:4] != secret[4:8]:
        return None
    return at, "openssh"


def pgp_key(b: bytes) -> tuple[int, str] | None:
    """OpenPGP packets (RFC 9580) that begin with a secret key and fill the bytes."""
    at, first = 0, None
    while at < len(b):
        head = b[at]
        if not head & 0x80 or at + 2 > len(b):
            return None
        if head & 0x40:
            tag, o = head & 0x3F, b[at + 1]
            if o < 192:
                n, at = o, at + 2
            elif o < 224:
                n, at = ((o - 192) << 8) + int.from_bytes(b[at + 2 : at + 3], "big") + 192, at + 3
            elif o == 255:
                n, at = int.from_bytes(b[at + 2 : at + 6], "big"), at + 6
            else:  # partial lengths are not allowed in keys
                return None
        else:
            tag, width = head >> 2 & 0xF, (1, 2, 4, 0)[head & 3]
            if not width:
                return None
            n, at = int.from_bytes(b[at + 1 : at + 1 + width], "big"), at + 1 + width
        if not n or at + n > len(b):
            return None
        if first is None:
            first = tag
            if tag != 5 or b[at] not in (3, 4, 5, 6):
                return None
        at += n
    return (at, "openpgp") if first is not None else None


def key_at(b: bytes) -> tuple[int, str] | None:
    return der_key(b) or openssh_key(b)


def unbase64(s: str) -> bytes:
    """The bytes of a run in either alphabet; what is left over at its end is not decoded."""
    s = s.translate({45: 43, 95: 47})
    s = s[: len(s) - (len(s) % 4 == 1)]
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return b""


def json_object(s: str) -> dict | None:
    try:
        got = json.loads(unbase64(s))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_token(header: str, claims: str, signature: str) -> str | None:
    """The algorithm of a signed token whose parts agree, or None."""
    head = json_object(header)
    alg = head.get("alg") if head else None
    if not isinstance(alg, str) or json_object(claims) is None:
        return None
    n = len(unbase64(signature))
    return alg if n in SIGNED.get(alg, ()) or alg in RSA_SIGNED and n in RSA_BYTES else None


def pem_keys(text: str) -> Iterator[tuple[str, int, int, str]]:
    for m in PEM.finditer(text):
        stop = text.find("-----", m.end())
        end = f"-----END {m[1]}-----"
        if stop < 0 or not text.startswith(end, stop):
            continue
        lines = [x.strip() for x in BREAK.sub("\n", text[m.end() : stop]).strip().split("\n")]
        heads = [x for x in lines if PEM_HEADER.fullmatch(x)]
        body = "".join(x for x in lines if x not in heads and not (x.startswith("=") and len(x) == 5))  # nor a checksum
        b = unbase64(re.sub(r"\s", "", body).rstrip("="))
        got = pgp_key(b) if m[1].endswith("BLOCK") else key_at(b)
        if got and got[0] == len(b):
            yield "key", m.start(), stop + len(end), got[1]
        elif b and len(b) % 8 == 0 and any(x.startswith("Proc-Type: 4,ENCRYPTED") for x in heads) and any(x.startswith("DEK-Info: ") for x in heads):
            yield "key", m.start(), stop + len(end), "pem-encrypted"


def run_keys(text: str, level: int) -> Iterator[tuple[str, int, int, str]]:
    """Keys in runs of base64 and hex. A wrapped run ends where a line ends and the key's own length says so."""
    for m in RUN.finditer(text):
        pieces, at = [], m.start()
        for x in BREAK.finditer(text, m.start(), m.end()):
            pieces.append((at, x.start()))
            at = x.end()
        pieces.append((at, m.end()))
        b = unbase64("".join(text[i:j] for i, j in pieces))
        got, n = key_at(b), 0
        if got:
            need = -(-got[0] * 4 // 3)
            for i, j in pieces:
                n += j - i
                if n >= need:
                    break
            if n == need:
                yield "key", m.start(), j + len(re.match("={0,2}", text[j : j + 2])[0]), got[1]
                continue
        yield from nested(b, m.start(), m.end(), level)
    for m in HEX_RUN.finditer(text):
        b = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        if (got := key_at(b)) and got[0] * 2 == len(m[0]):
            yield "key", m.start(), m.end(), f"{got[1]} in hex"
        else:
            yield from nested(b, m.start(), m.end(), level)


def nested(b: bytes, start: int, end: int, level: int) -> Iterator[tuple[str, int, int, str]]:
    """What is confirmed within text that the run decodes to is told at the run."""
    if level < NESTED and len(b) >= 30 and b[:30].isascii():
        inner = confirmed(b.decode("utf-8", "replace"), level + 1)
        for kind, detail in dict.fromkeys((x[0], x[3]) for x in inner):
            yield kind, start, end, f"{detail}, encoded"


def confirmed(text: str, level: int = 1) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of keys and tokens whose structure holds; none lies within another of its kind."""
    found = list(pem_keys(text)) if "-----BEGIN " in text else []
    found += run_keys(text, level)
    if "." in text:
        found += [("token", m.start(), m.end(), alg) for m in TOKEN.finditer(text) if (alg := signed_token(m[1], m[2], m[3]))]
    found.sort(key=lambda x: (x[0], x[1], -x[2], x[3]))
    out, reach, last = [], -1, None
    for x in found:
        if x[0] != last or x[2] > reach:
            out.append(x)
            reach, last = x[2], x[0]
    return out


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    return [(kind, m.start(), m.end(), "pattern") for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]


def secrets(text: str | None) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, detail, value) by start, then kind as listed."""
    if not text:
        return []
    found = base_spans(text) + confirmed(text)
    return [(*x, text[x[1] : x[2]]) for x in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]


def secrets_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "detail", "value"), x)) for x in secrets(t)] for t in texts], dtype=object)

    return found(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and secrets, an array of (kind, start, end, detail, value).

    Places are code points, the end exclusive. Null and empty texts have none (an empty array). Very long texts are read
    whole, in time that grows with their length. Repeated rows get equal results, null ids stay, an empty table stays
    empty. Only the id and the text are read, so other columns may have any name. No shuffle.
    """
    return docs.select(F.col(id_col).alias("doc_id"), secrets_column(F.col(text_col)).alias("secrets"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), count("key").alias("n_key"), count("token").alias("n_token")
    )
