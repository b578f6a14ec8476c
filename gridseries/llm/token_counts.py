"""Token counts of whole texts by a finite-state transducer compiled from a BPE vocabulary.

The transducer reads the byte letters of a word; the last one is a letter of its
own, because the vocabulary marks word ends. A state says what may still become
part of a later token: the longest end of the word read so far that begins some
token and, for each place in it, the last token of the encoding up to there and
how many tokens that encoding has. Reading a letter selects the one token that
ends there and fits behind the encoding before it, and so fixes the next state
and the number of tokens the transition emits (which can be negative when tokens
fuse). States are compiled when first reached and forgotten when there are too
many.

White space returns the transducer to its start. A chunk of a text is therefore
a map that is constant but for the part before its first white space: it is
kept as (head, tokens between, tail), maps of neighbouring chunks compose
associatively, and a text's count is the last entry of a prefix scan over its
chunks. A chunk's work does not depend on any other chunk.

Cases: a null or empty text has no tokens; special strings in a text count as
the library counts them; words with letters on which libraries may disagree are
counted by the library; null ids and repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.byte_tokens import byte_letters, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK_CHARS = 1 << 16
REMEMBERED = 300_000
MOST_STATES = 100_000  # about a kilobyte each
FINAL = 0xE000  # the last letter of a word is its letter shifted to here
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space for str.split, not for the tokenizer
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
END_OF_WORD = "</w>"


class Transducer:
    """States and transitions that emit token counts."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        def letters(token: str) -> str:
            if token.endswith(END_OF_WORD) and token != END_OF_WORD:
                token = token[: -len(END_OF_WORD)]
                return token[:-1] + chr(FINAL + ord(token[-1]))
            return token

        self.tokens = {letters(token) for token in vocabulary}
        self.ranks = {(letters(a), letters(b)): rank for rank, (a, b) in enumerate(merges)}
        self.beginnings = {token[:k] for token in self.tokens for k in range(len(token))}
        self.fits = functools.lru_cache(maxsize=1 << 18)(self._fits)
        self._forget()

    def _forget(self) -> None:
        start = ("", ((None, 0),))
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, word: str) -> list[str]:
        """The BPE encoding of a short string, by the merges themselves."""
        parts, rank_of = list(word), self.ranks.get
        while True:
            least, at = len(self.ranks), -1
            for place, pair in enumerate(zip(parts, parts[1:], strict=False)):
                rank = rank_of(pair, least)
                if rank < least:
                    least, at = rank, place
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: str | None, token: str) -> bool:
        """Whether `token` is encoded as one behind `before`."""
        if before is None:
            return self.merged(token) == [token]
        return self.merged(before + token) == [before, token]

    def _number(self, state: tuple) -> int:
        """The number of a state, a new one if it has none."""
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def _step(self, state: int, letter: str) -> tuple[int, int]:
        """Compile a transition: (tokens emitted, next state)."""
        ending, places = self.states[state]
        read = ending + letter
        for begin in range(len(read)):
            token = read[begin:]
            if token in self.tokens and self.fits(places[begin][0], token):
                break
        else:
            raise ValueError("a letter without a token")
        emitted = places[begin][1] + 1
        longer = [*places, (token, emitted)]
        for cut in range(len(read) + 1):
            if read[cut:] in self.beginnings:
                break
        if ord(letter) >= FINAL:
            step = (emitted, 0)
        else:
            step = (emitted, self._number((read[cut:], tuple((last, count - emitted) for last, count in longer[cut:]))))
        self.steps[state][letter] = step
        return step

    def count(self, word: str) -> int:
        """Tokens of one word, given as byte letters with the last one shifted."""
        state, total, steps = 0, 0, self.steps
        for letter in word:
            step = steps[state].get(letter)
            if step is None:
                if len(self.states) >= MOST_STATES:  # in the middle of a word as well: the state it is in stays
                    reached = self.states[state]
                    self._forget()
                    state, steps = self._number(reached), self.steps
                step = self._step(state, letter)
            total += step[0]
            state = step[1]
        return total


@functools.lru_cache(maxsize=1 << 14)
def _settled(char: str) -> bool:
    """Whether a character has kept its class since early Unicode, so that all libraries agree on it."""
    old = unicodedata.ucd_3_2_0.category(char)
    return old != "Cn" and old[0] == unicodedata.category(char)[0]


class _Counts(dict):
    """Word between white space -> number of tokens."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        number = self[word] = self.count(word)
        return number


class TokenCounter:
    """Counts tokens of texts; make one per process with `token_counter`."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        spec = json.loads(self.library.to_str())
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != END_OF_WORD or [n["type"] for n in spec["normalizer"]["normalizers"]] != [
            "NFC",
            "Replace",
            "Lowercase",
        ]:
            raise ValueError("not a lower-casing vocabulary with word ends")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges)
        self.letters = byte_letters()
        self.counts = _Counts(self._word)

    def _word(self, word: str) -> int:
        """Tokens of a string without white space."""
        if any(mark in word for mark in self.special):
            return len(self.library.encode(word, add_special_tokens=False).ids)
        if word.isascii():
            low = word.lower()
            parts = [low] if low.isalpha() else self.pattern.findall(low)
        elif all(map(_settled, word)):
            low = "".join([char.lower() for char in unicodedata.normalize("NFC", word)])
            parts = self.pattern.findall(low)
        else:
            return len(self.library.encode(word, add_special_tokens=False).ids)
        total = 0
        for part in parts:
            plain = part.isascii() and part.isprintable()
            read = part if plain else "".join([self.letters[byte] for byte in part.encode()])
            total += self.transducer.count(read[:-1] + chr(FINAL + ord(read[-1])))
        return total

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """A chunk's map: (head, tokens between, tail); the tail is None if the chunk has no white space."""
        odd = any(mark in text for mark in SEPARATORS)
        words = WHITE.split(text) if odd else text.split()
        if not odd:
            words = [""] * (not words or text[0].isspace()) + words + [""] * (not words or text[-1].isspace())
        if len(words) == 1:
            return text, 0, None
        return words[0], sum(map(self.counts.__getitem__, words[1:-1])), words[-1]

    def compose(self, left: tuple[str, int, str | None], right: tuple[str, int, str | None]):
        """The map of two neighbouring chunks."""
        if left[2] is None:
            return left[0] + right[0], right[1], right[2]
        if right[2] is None:
            return left[0], left[1], left[2] + right[0]
        between = left[2] + right[0]
        return left[0], left[1] + right[1] + (self.counts[between] if between else 0), right[2]

    def total(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text: its chunk maps composed pairwise, level by level."""
        maps = [self.chunk(text[at : at + chunk_chars]) for at in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        if not maps:
            return 0
        head, between, tail = maps[0]
        return between + sum(self._word(edge) for edge in (head, tail) if edge)


@functools.lru_cache(maxsize=2)
def token_counter(vocabulary: str = VOCABULARY) -> TokenCounter:
    """The counter of this process."""
    return TokenCounter(vocabulary)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in slices(batches):
            totals = pa.array([counter.total(text) for text in batch.column("text").to_pylist()], pa.int64())
            sizes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, totals], ["id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
