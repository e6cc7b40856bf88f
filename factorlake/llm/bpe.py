"""Tokenizer files of the `tokenizers` library, applied pre-token by pre-token.

Byte-pair merges never cross a pre-token, so that a text's ids are those of
its pre-tokens one after the other. Words repeat, and a worker that remembers
what it has encoded only runs the merges for words that it sees first.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import regex

#: What the "ByteLevel" pre-tokenizer of the library splits at (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the library's pattern engine; the regex module's own \s differs by four control characters.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

#: Scripts that the library and the regex module know from different Unicode versions: such texts go to the library whole.
RARE = regex.compile("[\U00010D00-\U0001CFFF\U0001DF00-\U0001EFFF\U0001FBF0-\U0010FFFF]")
#: The white space beyond ASCII, and the four control characters that only Python takes for white space.
WIDE_SPACE = regex.compile("[\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\U00010D00-\U0001CFFF\U0001DF00-\U0001EFFF\U0001FBF0-\U0010FFFF]")
CONTROLS = "\x1c\x1d\x1e\x1f"
#: White space before a space: there a pre-token may hold both.
DOUBLE = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


def _spaces(pattern: str) -> str:
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACE if depth else f"[{'^' * (two == chr(92) + 'S')}{SPACE}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        depth += (two[0] == "[") - (two[0] == "]")
        out.append(two[0])
        i += 1
    return "".join(out)


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokenized:
    """A tokenizer file whose pre-tokens this module can find; `known` is False for any other file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.marks = special
        self.known, self.fold, pattern = self._read(spec)
        self.find = regex.compile(_spaces(pattern)).findall if self.known else None
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = "".join(letters[b] for b in range(256))
        self.marks_ids = {c: self.ids(c) for c in ".,;:!?"} if self.known else {}

    @staticmethod
    def _read(spec: dict) -> tuple[bool, bool, str]:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or [])
        if not simple or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return False, False, ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return True, False, BYTE_LEVEL
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]:
            split = steps[0]
            # white space is no part of any match, so its replacement changes nothing
            if split["behavior"] == "Removed" and split["invert"] and not steps[1]["use_regex"]:
                return True, True, split["pattern"]["Regex"]
        return False, False, ""

    def normalize(self, text: str) -> str:
        if not self.fold:
            return text
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the library lowers each character by itself, str.lower() looks at a sigma's neighbours
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token's string is one of them."""
        if not text.isascii() and RARE.search(text):
            return [text]
        if self.special is not None and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return list(chain.from_iterable([p] if i % 2 else self.find(self.normalize(p)) for i, p in enumerate(parts)))
        return self.find(self.normalize(text))

    def words(self, text: str) -> list[str] | None:
        """The text cut at spaces, where every cut is also one between pre-tokens; None where that isn't sure.

        If the tokenizer drops white space, the words stand for themselves.
        Else every word but the first stands for itself after a space.
        """
        if any(m in text for m in self.marks) or not text.isascii() and WIDE_SPACE.search(text):
            return None
        if self.fold:
            return None if any(c in text for c in CONTROLS) else self.normalize(text).split()
        return None if any(d in text for d in DOUBLE) else text.split(" ")

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        """ids() of something that words() or pieces() gave: letters, one pre-token as they are, go to the merges directly."""
        end = self.marks_ids.get(piece[-1:])
        word = piece[:-1] if end else piece
        bare = word[1:] if word[:1] == " " and not self.fold else word
        if not bare.isalpha() or not bare.isascii() and RARE.search(bare):
            return self.ids(piece)
        if len(bare) == len(word) and bare.isascii():
            shown = word
        else:
            shown = "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(shown)] + (end or [])


class Remembered(dict):
    """pre-token -> value: a fixed table of frequent ones, and a cache of at most `most` others."""

    def __init__(self, value, frequent: dict | None = None, most: int = 1_000_000):
        super().__init__(frequent or {})
        self.value, self.frequent, self.most = value, frequent or {}, most + len(frequent or {})

    def __missing__(self, piece: str):
        v = self.value(piece)
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        if len(piece) <= 256:
            self[piece] = v
        return v


def pack_table(counts: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """A dict of pre-token lengths as three buffers: text, text lengths and values."""
    raw = [k.encode() for k in counts]
    return b"".join(raw), np.array([len(x) for x in raw], "<u2").tobytes(), np.array(list(counts.values()), "<u2").tobytes()


def unpack_table(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    text, sizes, values = table[0], np.frombuffer(table[1], "<u2"), np.frombuffer(table[2], "<u2")
    ends = np.cumsum(sizes.astype(np.int64))
    return {text[e - n : e].decode(): v for e, n, v in zip(ends.tolist(), sizes.tolist(), values.tolist())}
