"""Ed25519 signatures (RFC 8032), for the few that a manifest or a ledger has. Not for secrets: its time depends on them."""

from __future__ import annotations

import hashlib

# Fixed values of RFC 8032, section 5.1.
P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
BASE_Y = 4 * pow(5, P - 2, P) % P

Point = tuple[int, int, int, int]  # X, Y, Z, XY / Z


def _x(y: int, odd: int) -> int | None:
    """The x of a point of the curve with this y and last bit, if there is one."""
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if y >= P or (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x % 2 != odd else x


def _plus(a: Point, b: Point) -> Point:
    e = (a[1] - a[0]) * (b[1] - b[0])
    f = (a[1] + a[0]) * (b[1] + b[0])
    g, h = 2 * a[3] * b[3] * D, 2 * a[2] * b[2]
    u, v, w, t = f - e, h - g, h + g, f + e
    return u * v % P, w * t % P, v * w % P, u * t % P


def _times(n: int, a: Point) -> Point:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _plus(out, a)
        a = _plus(a, a)
        n >>= 1
    return out


BASE = (_x(BASE_Y, 0), BASE_Y, 1, _x(BASE_Y, 0) * BASE_Y % P)


def _packed(a: Point) -> bytes:
    inverse = pow(a[2], P - 2, P)
    return (a[1] * inverse % P | (a[0] * inverse % P & 1) << 255).to_bytes(32, "little")


def _point(raw: bytes) -> Point | None:
    number = int.from_bytes(raw, "little")
    y = number & (1 << 255) - 1
    x = _x(y, number >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def _expanded(secret: bytes) -> tuple[int, bytes]:
    whole = hashlib.sha512(secret).digest()
    return int.from_bytes(whole[:32], "little") & (1 << 254) - 8 | 1 << 254, whole[32:]


def public_key(secret: bytes) -> bytes:
    return _packed(_times(_expanded(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    scalar, prefix = _expanded(secret)
    own = _packed(_times(scalar, BASE))
    r = _number(prefix, message)
    first = _packed(_times(r, BASE))
    return first + ((r + _number(first, own, message) * scalar) % L).to_bytes(32, "little")


def verify(key: bytes, signature: bytes, message: bytes) -> bool:
    """Whether signature is one of message by the holder of key; False for malformed ones."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _plus(r, _times(_number(signature[:32], key, message), a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P or (left[1] * right[2] - right[1] * left[2]) % P)
