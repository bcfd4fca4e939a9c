"""Keccak-256 (the original padding, not SHA-3's), for signatures and topics at plan time."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """Bits of the linear feedback shift register x^8 + x^6 + x^5 + x^4 + 1, at places 2^j - 1."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


def _rotations() -> dict[tuple[int, int], int]:
    x, y, out = 1, 0, {(0, 0): 0}
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _TURNS = _round_constants(), _rotations()


def _turn(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    five = range(5)
    for constant in _CONSTANTS:
        c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in five]
        d = [c[x - 1] ^ _turn(c[(x + 1) % 5], 1) for x in five]
        b = {(y, (2 * x + 3 * y) % 5): _turn(a[x, y] ^ d[x], _TURNS[x, y]) for x in five for y in five}
        a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y] & _MASK) for x in five for y in five}
        a[0, 0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data) + b"\x01" + b"\x00" * (-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    state = {(x, y): 0 for x in range(5) for y in range(5)}
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            state[k % 5, k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        state = _permute(state)
    return b"".join(state[k % 5, k // 5].to_bytes(8, "little") for k in range(4))
