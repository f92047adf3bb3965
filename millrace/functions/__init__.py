"""Column functions: text rules, regular expressions, fingerprints."""

from .fingerprint import (
    hamming_distance,
    hashed_vector,
    minhash_signature,
    signature_agreement,
    simhash,
    word_bigrams,
)
from .regex import python_regex_replace, to_java_pattern, to_java_replacement
from .text import collapse, is_blank, sentences, squash, strip, strip_html, strip_tags, words
from .unicode import normalize_form

__all__ = [
    "collapse",
    "hamming_distance",
    "hashed_vector",
    "is_blank",
    "minhash_signature",
    "normalize_form",
    "python_regex_replace",
    "sentences",
    "signature_agreement",
    "simhash",
    "squash",
    "strip",
    "strip_html",
    "strip_tags",
    "to_java_pattern",
    "to_java_replacement",
    "word_bigrams",
    "words",
]
