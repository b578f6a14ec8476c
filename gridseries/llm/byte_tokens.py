"""Token ids of whole texts under the byte-level vocabulary of a tokenizer file.

The library's pre-tokenizer never joins what stands before a single space to
what follows it, so a text is the sequence of its words with the space before
each. Words are numbered, the ids of a number are remembered (up to a fixed
number of words), and only new words are encoded, many at once. Texts in which
white space touches white space, or that hold a special string, are cut
elsewhere or not at all, so that ids always equal those of the library on the
whole text.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 300_000
RARE = re.compile("[^\x00-ɏ]")  # letters that libraries may class differently
LONE_WORD = re.compile("^ (?! )[!-~\xa1-\u024f]+$", re.ASCII)  # joins with nothing before or after it


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path is left as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Touching(Exception):
    """White space at an end of a word: it may join with its neighbour."""


class _Words(dict):
    """Word -> its number; `new` lists the words numbered since it was last emptied.

    The first word of a text has a space before it here, because no space stands
    before it in the text; the others have none.
    """

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word):
        if not word or word[-1].isspace() and word != " " or word[0].isspace() and word[0] != " ":
            raise _Touching
        number = self[word] = len(self)
        self.new.append(word)
        return number


class ByteTokens:
    """Encodes texts; make one per process with `byte_tokens`."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.plain, self.sizes = _plain_encoder(self.library)
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.starts = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _one(self, piece: str) -> np.ndarray:
        if self.plain and not RARE.search(piece):
            return np.array(self.plain(piece), np.uint32)
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Encode the new words."""
        new, self.words.new = [word[1:] if word[0] == " " else " " + word for word in self.words.new], []
        if not new:
            return
        parts = [None] * len(new)
        easy = [i for i, word in enumerate(new) if self.plain and LONE_WORD.match(word)]
        if easy:
            joined = "".join([new[i] for i in easy])
            ids = np.array(self.plain(joined), np.uint32)
            ends = np.cumsum([len(new[i].encode()) for i in easy])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            for i, a, b in zip(easy, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                parts[i] = ids[a:b]
        for i, part in enumerate(parts):
            if part is None:
                parts[i] = self._one(new[i])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.pool = np.concatenate([self.pool, *parts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text."""
        if len(self.words) > REMEMBERED:
            self._forget()
        whole, numbers, counts = {}, [], []
        for at, text in enumerate(texts):
            words = text.split(" ")
            words[0] = " " + words[0]
            try:
                if any(mark in text for mark in self.special):
                    whole[at] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                    words = []
                numbers.append(np.array(list(map(self.words.__getitem__, words)), np.int64))
            except _Touching:
                whole[at] = self._one(text)
                numbers.append(np.zeros(0, np.int64))
            counts.append(len(numbers[-1]))
        self._learn()
        flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        lengths = self.starts[flat + 1] - self.starts[flat]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[flat] - before[:-1], lengths) + np.arange(before[-1])]
        edges = before[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        if whole:
            parts = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(edges)


def _plain_encoder(library):
    """The same merges through a faster library and the bytes of each id.

    Only for the byte-level pattern without normalizer; else (None, None).
    """
    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.loads(library.to_str())
    split = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex")
    if not plain or split.get("add_prefix_space") or spec["model"].get("end_of_word_suffix"):
        return None, None
    single = {letter: bytes([value]) for value, letter in byte_letters().items()}
    special = {token["content"] for token in spec["added_tokens"]}
    ranks = {
        b"".join([single[letter] for letter in token]): rank
        for token, rank in spec["model"]["vocab"].items()
        if token not in special
    }
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [value for value in range(256) if value not in set(shown)]
    return {value: chr(value) for value in shown} | {value: chr(0x100 + i) for i, value in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def byte_tokens(vocabulary: str = VOCABULARY) -> ByteTokens:
    """The encoder of this process."""
    return ByteTokens(vocabulary)
