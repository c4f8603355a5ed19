"""Secrets, fill-in-the-middle and vector codes against brute force, and on odd inputs."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("cairn.llm")
from cairn.llm import fill_middle, secret_scan, vector_codes  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, secrets string, form string, h1 string, blocks string, code string"


def frame(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(*x, "en", "a", 1, *["clash"] * 5) for x in rows], DOCS)


def written(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# keys, built by the standards and not by the operator's reader


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 + len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa_key(r):
    p, q = (r.getrandbits(256) | 1 << 255 for _ in range(2))
    return der(48, b"".join(integer(x) for x in (0, p * q, 65537, p * q - 7, p, q, p - 1, q - 1, p // 3)))


def pkcs8(oid, key):
    return der(48, integer(0) + der(48, der(6, oid) + b"\x05\x00") + der(4, key))


def ec_key(r):
    return der(48, integer(1) + der(4, r.randbytes(32)) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh(r):
    s = lambda b: len(b).to_bytes(4, "big") + b
    check = r.randbytes(4)
    secret = check + check + s(b"ssh-ed25519") + r.randbytes(100)
    secret += bytes(range(1, 1 + -len(secret) % 8))
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(r.randbytes(32))) + s(secret)


def pgp(r):
    body = b"\x04" + r.randbytes(300)
    return bytes([0xC0 | 5, 192 + (len(body) - 192 >> 8), (len(body) - 192) & 255]) + body + bytes([0xC0 | 13, 5]) + b"alice"


def wrapped(b, width=64, end="\n"):
    s = base64.b64encode(b).decode()
    return end.join(s[k : k + width] for k in range(0, len(s), width))


def url64(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def token(r, alg="HS256", size=32, header=None):
    return ".".join([url64(json.dumps(header or {"alg": alg, "typ": "JWT"}).encode()), url64(json.dumps({"sub": r.randrange(99)}).encode()), url64(r.randbytes(size))])


def test_confirmed_structures():
    """Every encoding is found at its place; the same bytes with a wrong length, a cut end or noise are not."""
    r = random.Random(3)
    rsa = rsa_key(r)
    keys = {"pkcs1": rsa, "pkcs8": pkcs8(secret_scan.RSA, rsa), "sec1": ec_key(r), "openssh": openssh(r)}
    keys["pkcs8 of a curve"] = pkcs8(bytes.fromhex("2b6570"), der(4, r.randbytes(32)))
    keys["pkcs8-encrypted"] = der(48, der(48, der(6, bytes.fromhex("2a864886f70d01050d")) + der(48, b"")) + der(4, r.randbytes(48)))
    for name, b in keys.items():
        for text in (base64.b64encode(b).decode(), wrapped(b), wrapped(b, 76, "\\n"), wrapped(b, 64, "\r\n  "), b.hex(), b.hex().upper()):
            got = secret_scan.confirmed(f"größe = {text}\nThen more words")
            assert [(k, s, e) for k, s, e, _ in got] == [("key", 8, 8 + len(text))], (name, text[:40])
            assert got[0][3].split(" in ")[0] == name.split(" ")[0]
        bad = b[:1] + bytes([b[1] ^ 1]) + b[2:]
        for other in (bad, b[:-1] + b"", r.randbytes(len(b))):
            assert secret_scan.confirmed(base64.b64encode(other).decode()) == [] and secret_scan.confirmed(other.hex()) == []
    label = "-----{} RSA PRIVATE KEY-----"
    pem = label.format("BEGIN") + "\n" + wrapped(rsa) + "\n" + label.format("END")
    assert secret_scan.confirmed("x " + pem + " y") == [("key", 2, 2 + len(pem), "pkcs1")]
    assert [x[:3] for x in secret_scan.confirmed(pem.replace("END", "FIN"))] == [("key", 32, 32 + len(wrapped(rsa)))]  # the run is still a key
    locked = pem.replace("-----\n", "-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n", 1).replace(wrapped(rsa), wrapped(r.randbytes(64)))
    assert secret_scan.confirmed(locked) == [("key", 0, len(locked), "pem-encrypted")]
    armor = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x\n\n" + wrapped(pgp(r)) + "\n=AbCd\n-----END PGP PRIVATE KEY BLOCK-----"
    assert secret_scan.confirmed(armor) == [("key", 0, len(armor), "openpgp")]
    twice = base64.b64encode(("config:\n" + pem).encode()).decode()
    assert secret_scan.confirmed("k " + twice) == [("key", 2, 2 + len(twice.rstrip("=")), "pkcs1, encoded")]
    public = base64.b64encode(der(48, der(48, der(6, secret_scan.RSA) + b"\x05\0") + der(3, b"\0" + der(48, integer(2**512) + integer(65537))))).decode()
    assert secret_scan.confirmed(public) == []


def test_signed_tokens():
    r = random.Random(4)
    for alg, size in (("HS256", 32), ("HS512", 64), ("RS256", 256), ("ES384", 96), ("EdDSA", 64)):
        t = token(r, alg, size)
        assert secret_scan.confirmed(f"Bearer {t}, x") == [("token", 7, 7 + len(t), alg)]
        assert secret_scan.confirmed(token(r, alg, 31)) == []
    for t in (token(r, "none", 32), token(r, header={"typ": "JWT"}), token(r, header=["alg"]), token(r).replace(".", "_"), "eyJ." + token(r)[5:], "example.com.au " * 9):
        assert secret_scan.confirmed(t) == []


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""


def brute_base(text):
    text, out = text or "", []
    for rank, (kind, pattern, least) in enumerate((("assign", ASSIGN, 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32))):
        at = 0
        while at < len(text):
            m = re.compile(pattern, re.A).match(text, at)
            if m and len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}", kind))
            at = m.end() if m else at + 1
    return [(x[2], x[3]) for x in sorted(out)]


def test_secret_scan_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", " ", "  ", ":", "=", '"', "'", "AKIA", "AKIAB7", "0f" * 9, "deadbeef", "Zq9/+", "x.y-z", "ü", "😀", "\n", "ſecret=abcdefgh1"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)] + [None, "", "token=eyJ" + "a" * 50_000]
    signed, key = token(r), base64.b64encode(rsa_key(r)).decode()
    texts += [f"😀 token: {signed} and {key}"] * 3
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    got = secret_scan.op11_secret_scan(spark, written(spark, tmp_path, documents=frame(spark, rows))).collect()
    want = []
    for k, t in rows:
        base = brute_base(t)
        told = ",".join(x for x, _ in base)
        want.append((k, *[sum(kind == y for _, y in base) for kind in ("assign", "access", "hex")], hashlib.sha256(told.encode()).hexdigest(), told))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted((w[0] is None, w[0] or 0, *w[1:5]) for w in want)
    for row in got:
        if row.n_key + row.n_token == 0:
            assert hashlib.sha256(row.spans.encode()).hexdigest() == row.base_sha256
    a = len("😀 token: ")
    b = a + len(signed) + len(" and ")
    both = [x for x in got if x.n_key]
    assert len(both) == 3 and {x.spans for x in both} == {f"assign:2:{a + len(signed)},token:{a}:{a + len(signed)},key:{b}:{b + len(key)}"}


def test_odd_values_secret_scan(spark):
    long = "QUJD" * 300_000
    rows = [(1, None), (2, ""), (None, "token=abcdefgh"), (3, long), (3, long), (4, "a" * 500_000), (5, "-----BEGIN PRIVATE KEY-----" * 20_000), (6, "password" + " " * 200_000), (7, "e." * 200_000)]
    began = time.time()
    got = secret_scan.find_secrets(frame(spark, rows)).collect()
    assert time.time() - began < 60 and len(got) == len(rows)
    found = {r.doc_id: [tuple(x) for x in r.secrets] for r in got}
    assert found == {1: [], 2: [], None: [("assign", 0, 14, "pattern", "token=abcdefgh")], 3: [], 4: [("hex", 0, 500_000, "pattern", "a" * 500_000)], 5: [], 6: [], 7: []}
    assert secret_scan.find_secrets(frame(spark, [])).count() == 0


def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n, sha = len(text), lambda s: hashlib.sha256(s.encode()).hexdigest()
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", lo, hi - lo, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_middle_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    bits = ["a", "é", "é", "😀", "👩‍👩‍👧", "\n", "\r\n", " ", " ", "\0", "<", "<P", "<S", "<M", "P>", "￿", "𝔸"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([1, 2, 5, 40, 3000]))) for _ in range(250)] + [None, "", "a<P>b", "x<S>", "<M>", "<P", "😀" * 1024, "😀a" * 1024, "y" * 1025, "z" * 300_000]
    rows = [(r.choice([k, k, k, None]), t) for k, t in enumerate(texts)]
    rows += rows[:9]
    got = fill_middle.op12_fill_middle(spark, written(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_middle(*x) for x in rows), key=repr)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0


@pytest.mark.parametrize("unit", fill_middle.GRAMMARS)
def test_units_of_a_grammar(spark, unit):
    """Pieces join to the text and end just where the classes say; cuts fall between them."""
    r = random.Random(7)
    texts = ["".join(r.choice("aB9_ \n-é😀") for _ in range(r.randrange(1, 60))) for _ in range(60)] + [""]
    df = frame(spark, list(enumerate(texts)))
    pairs = [(re.compile(a), re.compile(b)) for a, b in fill_middle.GRAMMARS[unit]]
    cuts = {t: [k for k in range(1, len(t)) if any(a.fullmatch(t[k - 1]) and b.fullmatch(t[k]) for a, b in pairs)] for t in texts}
    for x in df.select("text", fill_middle.pieces(F.col("text"), fill_middle.GRAMMARS[unit]).alias("p")).collect():
        at = [0, *cuts[x.text], len(x.text)]
        assert list(x.p) == [x.text[i:j] for i, j in zip(at, at[1:])] if x.text else x.p == []
    made = fill_middle.fill_middle(df, unit)
    for x in made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect():
        text = texts[x.doc_id]
        assert x.back == text and x.n == (len(cuts[text]) + 1 if text else 0)
        if x.form != "plain":
            ends = [0, *cuts[text], len(text)]
            assert x.prefix + x.middle + x.suffix == text and len(x.prefix) == ends[x.prefix_units] and len(x.prefix + x.middle) == ends[x.prefix_units + x.middle_units]


def brute_codes(rows, dim):
    """rows: (vec_id, vector, label), ids unique."""
    ok = sorted((i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = dim // 4
    parts = lambda v: [v[p * w : p * w + w] for p in range(4)]
    books = [[parts(v)[p] for _, v, _ in ok[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(4):
        at = [[near(parts(v)[p], books[p])[1] for _, v, _ in ok] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                own = [parts(v)[p] for (_, v, _), k in zip(ok, at[p]) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, lab in ok:
        got = [near(parts(v)[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    return sorted((i, c, e, sums[lab], sha) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, error string, _label string"


def vectors(spark, rows):
    return spark.createDataFrame([(*x, "clash", "clash", "clash", "clash") for x in rows], VECTORS)


def test_vector_codes_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    coarse = lambda: [r.choice([-1.0, -0.25, 0.0, 0.0009, -0.0009, 0.5]) for _ in range(8)]  # noqa: E731  ties of every kind
    rows = [(3 * i - 100, coarse() if i % 3 else [r.gauss(0, 0.3) for _ in range(8)], r.choice([1, 2, None])) for i in range(600)]
    rows += [(5000 + i, v, 1) for i, v in enumerate([None, [math.nan] * 8, [math.inf] + [0.0] * 7, [None] + [0.0] * 7, [0.0] * 8])]
    for n, own in (("many", rows), ("few", rows[:20])):
        own = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v], lab) for i, v, lab in own]
        got = vector_codes.op13_vector_codes(spark, written(spark, tmp_path / n, embeddings=vectors(spark, own))).collect()
        assert sorted(map(tuple, got)) == brute_codes(own, 8)


def test_partial_distances_are_exact():
    import numpy as np

    r = np.random.default_rng(9)
    for n, k, d, high in ((500, 256, 16, 300), (300, 7, 5, 3), (1, 1, 1, 9), (40, 256, 1, 4), (200, 64, 32, 1 << 26)):
        x, book = r.integers(-high, high, (n, d)), r.integers(-high, high, (k, d))
        full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, best = vector_codes.nearest(x, book)
        assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_odd_values_vector_codes(spark):
    same, other = [0.5] * 8, [-0.5] * 8
    rows = [(1, same, 1), (1, same, 1), (1, other, 1), (None, same, None), (2, [0.1] * 4, 1), (3, [], 1), (4, None, None), (5, [3e30] + [0.0] * 7, 1), (6, other, None)]
    codes, books = vector_codes.compress(vectors(spark, rows))
    got = sorted(((x.vec_id, x.label, x.code, x.error, x.label_error) for x in vector_codes.label_errors(codes).collect()), key=repr)
    # entries: id 1 (its smallest vector), 6 and null; equal entries lose to the first
    assert got == sorted([(1, 1, "02" * 4, 0, 0), (1, 1, "02" * 4, 0, 0), (1, 1, "00" * 4, 0, 0), (None, None, "02" * 4, 0, 0), (6, None, "00" * 4, 0, 0)], key=repr)
    assert [len(b) for b in books] == [3] * 4
    empty, books = vector_codes.compress(vectors(spark, []))
    assert vector_codes.label_errors(empty).count() == 0 and books == []
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [0.0] * 6, 1)]))
