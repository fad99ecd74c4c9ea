"""Secret scan: plain patterns against a plain version, structures built by hand."""

import base64
import hashlib
import json
import random
import re

from lectern.llm import secret_scan as S
from lectern.llm.catalog import op13_secret_scan
from tests.llm.conftest import documents

rng = random.Random(11)


def octets(n):
    return bytes(rng.randrange(1, 128) for _ in range(n))


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda k: bytes([0x80 | len(k)]) + k)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return der(2, n if isinstance(n, bytes) else bytes([n]))


OID = lambda h: der(6, bytes.fromhex(h))
RSA = der(0x30, number(0), number(octets(128)), number(octets(3)), *[number(octets(64)) for _ in range(6)])
DSA = der(0x30, number(0), number(octets(128)), *[number(octets(20)) for _ in range(4)])
EC = der(0x30, number(1), der(4, octets(32)), der(0xA0, OID("2a8648ce3d030107")), der(0xA1, der(3, b"\0" + octets(65))))
PKCS8 = der(0x30, number(0), der(0x30, OID("2a864886f70d010101"), b"\x05\x00"), der(4, RSA))
ED25519 = der(0x30, number(0), der(0x30, OID("2b6570")), der(4, der(4, octets(32))))
ENCRYPTED = der(0x30, der(0x30, OID("2a864886f70d01050d"), der(0x30, der(4, octets(16)))), der(4, octets(160)))
PKCS12 = der(0x30, number(3), der(0x30, OID("2a864886f70d010701"), der(0xA0, der(4, octets(200)))), der(0x30, der(4, octets(20))))
PUBLIC = der(0x30, der(0x30, OID("2a864886f70d010101"), b"\x05\x00"), der(3, b"\0" + der(0x30, number(octets(128)), number(3))))
CERT = der(0x30, der(0x30, der(0xA0, number(2)), number(octets(8)), der(0x30, OID("2a864886f70d01010b"))), der(3, b"\0" + octets(128)))


def string(b):
    return len(b).to_bytes(4, "big") + b


def ssh(secret):
    return (b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big")
            + string(string(b"ssh-ed25519") + string(octets(32))) + string(secret))


SSH = ssh(b"\1\2\3\4" * 2 + string(b"ssh-ed25519") + string(octets(32)) + string(octets(64)) + string(b"me"))


def b64(b):
    return base64.b64encode(b).decode()


def url(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def lines(s, n=64, gap="\n"):
    return gap.join(s[i:i + n] for i in range(0, len(s), n))


def token(head, body=b'{"sub": "x"}', size=32):
    return ".".join([url(json.dumps(head).encode()), url(body), url(octets(size))])


def of(text, kind):
    return [text[s:e] for s, e, k in S.scan(text) if S.KINDS[k] == kind]


def test_private_keys_in_every_encoding():
    for key in (RSA, DSA, EC, PKCS8, ED25519, ENCRYPTED, PKCS12, SSH):
        for code in (b64(key), url(key), lines(b64(key)), lines(b64(key), 76, "\r\n"), lines(b64(key), 64, "\\n"),
                     lines(b64(key), 64, "\n    ")):
            for before, after in (("", ""), ("-----BEGIN KEY-----\n", "\n-----END KEY-----\n"), ("Schlüssel 日: ", " end"),
                                  ("data:x;base64,", "\nnext line"), ("path/", "")):
                assert of(before + code + after, "key") == [code], (before, code)
    for key in (RSA, EC, ED25519, ENCRYPTED):
        assert of("0x" + key.hex() + " rest", "key") == [key.hex()]
        assert of("<" + key.hex().upper() + ">", "key") == [key.hex().upper()]
    blob = b64(b"-----BEGIN RSA PRIVATE KEY-----\n" + lines(b64(RSA)).encode() + b"\n-----END RSA PRIVATE KEY-----\n")
    assert of(f"client-key-data: {blob}\n", "key") == [blob]


def test_two_keys_side_by_side_and_a_key_after_a_false_start():
    text = f"{b64(EC)} {b64(RSA)}\nMIIBAA{'A' * 60} {b64(PKCS8)}"
    assert of(text, "key") == [b64(EC), b64(RSA), b64(PKCS8)]


def test_structures_that_are_no_private_keys():
    for other in (PUBLIC, CERT, der(0x30, number(0), der(4, octets(200))), der(0x30, *[number(octets(40)) for _ in range(9)])):
        assert of(b64(other), "key") == [] and of(other.hex(), "key") == []
    for key in (RSA, PKCS8, EC, SSH):
        cut, code = b64(key[:-3]), bytearray(key)
        assert of(cut, "key") == []                       # the lengths do not nest any more
        code[len(key) // 2 if key is SSH else 4] ^= 0x7F
        if key is not SSH:
            assert of(b64(bytes(code)), "key") == []
    assert of(b64(ssh(b"\1\2\3\4\5\6\7\x08" + octets(60))), "key") == []      # check words differ
    random_64 = b64(bytes(rng.randrange(256) for _ in range(60_000)))
    assert of(random_64, "key") == [] and of("M" * 50_000, "key") == [] and of("30" * 50_000, "key") == []


def test_signed_tokens():
    good = [token({"alg": "HS256", "typ": "JWT"}), token({"alg": "ES384"}, size=96), token({"typ": "JWT", "alg": "RS256"}, size=256),
            token({"alg": "EdDSA"}, size=64)]
    sealed = ".".join([url(b'{"alg":"dir","enc":"A256GCM"}'), "", url(octets(12)), url(octets(50)), url(octets(16))])
    for t in good + [sealed]:
        assert of(f"Authorization: Bearer {t}\n", "token") == [t] and of(t + ".", "token") == [t]
    bad = [token({"alg": "none"}, size=0), token({"alg": "HS256"}, size=31), token({"typ": "JWT"}), token({"alg": 7}),
           token({"alg": "HS256"}, b"no object"), "eyes.are.open", "ey" * 30_000, token({"alg": "HS512"}, size=32),
           "x" + good[0], "ey" + "." * 5000]
    for t in bad:
        assert of(t, "token") == [], t[:60]


def plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text or "", re.I | re.A):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if m.end() - m.start() >= 16]
    return sorted(out)


def test_query_equals_a_plain_version(spark, tmp_path):
    pieces = ["password", "PassWd", "secret", "ſecret", "toKen", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA",
              "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "ümlaut", "日", "A1+/_.=-", "\n", "hunter2", "ff", "Z"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "password: secret: abcdefghijklmnop", "token=" + token({"alg": "HS256"}), b64(RSA), "AKIAAKIA" + "A" * 20,
              "x " * 400_000 + "secret = abcdefghijkl", "f" * 100_000]
    ids = list(range(len(texts) - 1)) + [3]
    docs = documents(spark, texts, ids=ids).withColumnRenamed("score", "secrets").withColumnRenamed("size", "spans")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
                 for r in op13_secret_scan(spark, str(tmp_path)).collect())
    want = []
    for i, t in zip(ids, texts):
        base = plain_base(t)
        listed = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        more = [(s, k, e, S.KINDS[k]) for s, e, k in S.scan(t) if k > 2]
        want.append((i, *[sum(x[3] == k for x in base) for k in S.KINDS[:3]],
                     hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more))))
    assert got == sorted(want)
    assert sum(r[1] for r in got) > 20 and any("token:" in r[5] for r in got) and any("key:" in r[5] for r in got)


def test_empty_table(spark):
    assert S.find(documents(spark, [])).collect() == []
