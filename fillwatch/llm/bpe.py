"""Byte-level BPE on Python workers: token counts by the whole-token shortcut, and ids of whole texts.

Pre-tokens of a byte-level vocabulary are merged independently of each other, so

* a pre-token that is a vocabulary string which encodes alone as one token counts one:
  ``whole_tokens`` proves that for each string of the vocabulary with the library itself,
  before any text is read;
* all others are merged, once per distinct pre-token while it stays in the worker's table.

A text is first cut at single blanks and newlines between visible characters. The
pre-tokenizer has no look-behind and its only look-ahead ends runs of white space, so no
pre-token crosses such a cut and each piece may be looked up on its own. Texts with other
white space are cut into pre-tokens by the public pattern instead.

Merging uses the faster of two public BPE libraries. It works on ranks and takes a vocabulary
string whole; both are proven equal to the file's own library first (merges in the order of
their ids, and every vocabulary string that is a text encodes alone as one token). Where the
proof or a premise fails, the file's library encodes the texts.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_ROWS = 300_000  # distinct pieces a worker keeps; the memory bound of the shortcut


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves,
    the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Tokenizer, dict, bool]:
    """The library's tokenizer, the parsed file, and whether the shortcut's premises hold."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    pre = config.get("pre_tokenizer") or {}
    plain = (config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and config["model"].get("type", "BPE") == "BPE"
             and not config["model"].get("dropout") and not config.get("truncation") and not config.get("padding"))
    return Tokenizer.from_file(path), config, plain


@lru_cache(maxsize=2)
def vocabulary_texts(path: str) -> tuple[str, ...]:
    """Vocabulary strings that are texts by themselves (the others end inside a character)."""
    byte, out = _byte_of(), []
    for piece in load(path)[0].get_vocab(with_added_tokens=False):
        try:
            out.append(bytes(byte[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    return tuple(out)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes alone as one token."""
    tok, _, plain = load(path)
    texts = list(vocabulary_texts(path)) if plain else []
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


@lru_cache(maxsize=2)
def ranked(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, if that is proven to give the same ids."""
    import public_tokenizers

    tok, config, plain = load(path)
    added = config.get("added_tokens", [])
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        return None
    byte, vocab = _byte_of(), config["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in config["model"]["merges"]]
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or len(whole_tokens(path)) < len(vocabulary_texts(path)):
        return None
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={a["content"]: a["id"] for a in added})


def text_ids(path: str, text: str) -> np.ndarray:
    """ids of a whole text (unsigned 32-bit), special strings inside it as the library takes them."""
    enc = ranked(path)
    if enc is None:
        return np.asarray(load(path)[0].encode(text, add_special_tokens=False).ids, "<u4")
    return enc.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class _Counts(dict):
    """Text piece -> its number of tokens; ``None`` where a piece may not stand alone."""

    def __init__(self, counter: TokenCounter, lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, piece: str) -> int | None:
        if len(self) >= CACHE_ROWS:
            self.clear()
        n = None
        if piece and not piece[0].isspace() and not piece[-1].isspace():
            n = self.counter.of_pretokens(self.lead + piece)
        self[piece] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        import public_tokenizers

        self.path = path
        _, config, self.plain = load(path)
        self.added = [a["content"] for a in config.get("added_tokens", [])]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.whole = whole_tokens(path)
        self.first, self.later = _Counts(self, ""), _Counts(self, " ")
        enc = ranked(path)
        self.merge = enc.encode_ordinary if enc else lambda t: load(path)[0].encode(t, add_special_tokens=False).ids
        self.newline = self.of_pretokens("\n") if self.plain else 0

    def of_pretokens(self, text: str) -> int:
        """Pre-tokens that are whole tokens count one; only the rest is merged."""
        return sum([1 if p in self.whole else len(self.merge(p)) for p in self.cut(text)])

    def count(self, text: str) -> int:
        if not self.plain or any(a in text for a in self.added):
            return len(text_ids(self.path, text))
        if not text:
            return 0
        lines = text.split("\n")
        total = self.newline * (len(lines) - 1)
        if len(lines) > 1 and not lines[-1]:
            lines.pop()  # a newline ends the text
        first, later = self.first.__getitem__, self.later.__getitem__
        try:
            for line in lines:
                head, *rest = line.split(" ")
                total += first(head) + sum(map(later, rest))
        except TypeError:  # a piece that may not stand alone
            return self.of_pretokens(text)
        return total


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """One per Python worker."""
    return TokenCounter(path)
