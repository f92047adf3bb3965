"""Plain Python forms of the rules, written for the tests, to compare with on small data."""

from __future__ import annotations

import hashlib
import re

SIGNED = 1 << 64


def signed(value: int) -> int:
    return value - SIGNED if value >> 63 else value


def simhash(text, word_variant=False):
    lowered = (text or "").lower()
    tokens = re.findall(r"\w+", lowered) if word_variant else lowered.split()
    if not tokens:
        return 0
    hashes = []
    for token in tokens:
        digest = hashlib.md5(token.encode()).hexdigest()
        hashes.append(int(digest[16:] if word_variant else digest[:16], 16))
    result = 0
    for bit in range(64):
        ones = sum(h >> bit & 1 for h in hashes)
        balance = 2 * ones - len(hashes)
        if balance > 0 or (balance == 0 and not word_variant):
            result |= 1 << bit
    return signed(result)


def bigrams(text):
    tokens = (text or "").lower().split()
    return {" ".join(pair) for pair in zip(tokens, tokens[1:])} or set(tokens)


def minhash(text, size=64):
    bases = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in bigrams(text)]
    return [min([(b ^ (i * 0x45D9F3B)) & 0xFFFFFFFF for b in bases], default=0xFFFFFFFF) for i in range(size)]


def differing_bits(a, b):
    return bin((a ^ b) % SIGNED).count("1")


def agreement(a, b):
    return sum(x == y for x, y in zip(a, b))


def jaccard(a, b):
    return 1.0 if not (a | b) else len(a & b) / len(a | b)


def greedy(sketches, similar):
    """Positions that stay when each row is compared with the earlier ones that stayed."""
    kept = []
    for i, sketch in enumerate(sketches):
        if not any(similar(sketches[k], sketch) for k in kept):
            kept.append(i)
    return kept


def chunks(text, size, overlap):
    tokens = (text or "").split()
    step = size - overlap if size > overlap else size
    out = []
    for start in range(0, len(tokens), step):
        window = tokens[start : start + size]
        out.append(" ".join(window))
        if len(window) < size:
            break
    return out
