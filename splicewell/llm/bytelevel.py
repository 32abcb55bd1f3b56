"""Bytes as the printable characters that byte-level vocabularies are written in, and a bounded memory."""

from __future__ import annotations


def _alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TABLE = _alphabet()


def spelled(text: str) -> str:
    """A string in the vocabulary's characters."""
    return "".join(map(_TABLE.__getitem__, text.encode("utf-8", "surrogatepass")))


class Memory(dict):
    """What a function gave for its arguments; holds two generations of at most ``size`` entries each, none with a key over ``longest``."""

    def __init__(self, made, size: int, longest: int = 1000):
        self.made, self.size, self.longest, self.older = made, size, longest, {}

    def keep(self, key, found) -> None:
        if len(key) > self.longest:
            return
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.made(key)
        self.keep(key, found)
        return found
