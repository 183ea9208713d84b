"""The signature scheme against published vectors, and tampering with each part."""

from plumbline.functions import ed25519
from plumbline.operators import governance as G

SECRET = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
KEY = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
SIGNATURE = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")


def test_published_vector():
    assert ed25519.public_key(SECRET) == KEY and ed25519.sign(SECRET, b"") == SIGNATURE
    assert ed25519.verify(KEY, SIGNATURE, b"")


def test_tampering():
    signed = ed25519.sign(SECRET, b"message")
    assert ed25519.verify(KEY, signed, b"message") and not ed25519.verify(KEY, signed, b"massage")
    for k in (0, 31, 32, 63):
        assert not ed25519.verify(KEY, signed[:k] + bytes([signed[k] ^ 1]) + signed[k + 1 :], b"message")
    assert not ed25519.verify(KEY[:-1], signed, b"message") and not ed25519.verify(b"\xff" * 32, signed, b"message")
    s = int.from_bytes(signed[32:], "little") + ed25519.L
    assert not ed25519.verify(KEY, signed[:32] + s.to_bytes(32, "little"), b"message")


def test_signed_documents(spark):
    digest = G.sha256_hex('{"a":1}')
    docs = spark.createDataFrame([("good", '{"a": 1}', digest), ("altered", '{"a": 2}', digest), ("none", '{"a": 1}', None)], "name string, payload string, digest string")
    both = G.signed(docs, SECRET)
    named = lambda df: {r.name: r.status for r in G.verify_signatures(df).collect()}
    key = G.F.lit(KEY.hex()).alias("key")
    assert named(both.select("*", key)) == {"good": "PASS", "altered": "FAIL", "none": "FAIL"}
    assert named(both.select("name", "payload", "digest", G.F.lit("zz").alias("signature"), key)) == {"good": "FAIL", "altered": "FAIL", "none": "FAIL"}
