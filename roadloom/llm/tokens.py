"""Word splitting and encoding for byte-level BPE vocabularies in the ``tokenizers`` JSON format."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# The byte-level pre-tokenizer's rule; the first form is the same over ASCII.
_ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WORDS = regex.compile(
    r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f" (?=[^{_SPACES}])")
_SPACE_RUN = re.compile(f" [{_SPACES}]")
_SPACE_SET = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_LAST_SPACE = re.compile(f"[{_SPACES}](?=[{_SPACES}][^{_SPACES}])")


def words_of(piece: str) -> list[str]:
    tail = piece[1:]
    if piece[:1] == " " and tail:
        if tail.isalpha():
            return [piece]
        if tail[-1] in ".,;:!?" and tail[:-1].isalpha():
            return [piece[:-1], tail[-1]]
    return (_ASCII_WORDS if piece.isascii() else _WORDS).findall(piece)


def chunks_of(text: str) -> list[str]:
    """Pieces that join to ``text``, cut before single spaces, where no word goes across.

    There are far fewer different pieces than positions, so what is worked out
    once for a piece serves many.
    """
    first, *rest = _CUT.split(text) if _SPACE_RUN.search(text) or text.endswith(" ") else text.split(" ")
    chunks = [" " + x for x in rest]
    if first:
        chunks.insert(0, first)
    return chunks


@cache
def special_tokens(path: str) -> re.Pattern | None:
    """Matches the vocabulary's added tokens, which are taken out before words are split."""
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens") or []]
    return re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


def spans_of(text: str, path: str) -> list[tuple[str, bool]]:
    """The text in order, cut into ordinary stretches (False) and added tokens (True)."""
    special, out, at = special_tokens(path), [], 0
    for m in special.finditer(text) if special else ():
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((m[0], True))
        at = m.end()
    if at < len(text):
        out.append((text[at:], False))
    return out


def text_chunks(text: str, path: str) -> list[str]:
    """``chunks_of`` with every added token as a chunk of its own."""
    special = special_tokens(path)
    if special is None or not special.search(text):
        return chunks_of(text) if text else []
    return [c for part, added in spans_of(text, path) for c in ([part] if added else chunks_of(part))]


def chunk_words(chunk: str, path: str) -> list[str]:
    special = special_tokens(path)
    return [chunk] if special is not None and special.fullmatch(chunk) else words_of(chunk)


@cache
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def _ranked(path: str) -> tiktoken.Encoding | None:
    """The vocabulary as ranks, many times faster; only where ids follow the order of merges, so that ids are the same."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    if spec.get("normalizer") or not all(vocab.get(x) == 256 + i for i, x in enumerate(joined)):
        return None
    ranks = {b: i for i, b in enumerate(pieces_of(path)) if i < 256 + len(merges)}
    # without the look-ahead for runs of spaces, which text_ids cuts beforehand
    rule = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    return tiktoken.Encoding("ranks", pat_str=rule, mergeable_ranks=ranks, special_tokens={})


def _has_long_space(text: str) -> bool:
    """Whether two space characters stand side by side."""
    found = _SPACE_SET.intersection(text)
    return any(a + b in text for a in found for b in found)


@cache
def _added_ids(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


def text_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text, unsigned 32-bit; null counts as empty."""
    if not text:
        return np.zeros(0, dtype="<u4")
    ranked, special = _ranked(path), special_tokens(path)
    if ranked is None:
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    if not _has_long_space(text) and not (special and special.search(text)):
        return ranked.encode_to_numpy(text, disallowed_special=())
    parts = []
    for part, added in spans_of(text, path):
        if added:
            parts.append(np.array([_added_ids(path)[part]], dtype="<u4"))
            continue
        at = 0
        for m in [*_LAST_SPACE.finditer(part), None]:
            parts.append(ranked.encode_to_numpy(part[at : m.start() + 1 if m else len(part)], disallowed_special=()))
            at = m.start() + 1 if m else at
    return np.concatenate(parts).astype("<u4")


def word_ids(word: str, path: str) -> list[int]:
    """Ids of one word, as ``chunk_words`` gives them, or of an added token."""
    ranked = _ranked(path)
    if ranked is None:
        return tokenizer(path).encode(word, add_special_tokens=False).ids
    added = _added_ids(path).get(word)
    return ranked.encode_ordinary(word) if added is None else [added]


@cache
def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id; byte-level vocabularies spell bytes as printable characters."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pieces = {i: bytes(byte[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in byte for c in piece)}
    pieces |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]
