"""Secrets in texts: known forms, and random strings found by how badly they tokenize.

Known forms are an assignment to a telling name, an access key and a long
hexadecimal run. The token-efficiency test adds strings of key characters that
need many tokens of a public vocabulary for their length: words and paths are
covered by long tokens, random characters are not. A run of key characters is
tested as a whole; if it has too few tokens, its stretches between + / _ - = that
have many are tested, so that a name or path beside a value does not hide it.
Digests of known lengths, UUIDs and strings of one kind of character (numbers,
plain words) are left out.

Cases: a null or empty text has no spans; spans of one kind never overlap; known
forms are cut out of a run before it is tested, together with the joints beside them; null ids and
repeated rows are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from gridseries.llm.batches import id_and_text, slices
from gridseries.llm.byte_tokens import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN = 2.0
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The known forms.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGNED_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a whole run, as for [0-9a-f]+ with short runs dropped
KEY_CHARS = 20
KEY_LIKE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
JOINTS = "+/_=-"
PART = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")  # the vocabulary's words never reach over two of these
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAMED = re.compile(rf"(?<![0-9A-Za-z])(?:{UUID.pattern}|[0-9a-f]+|[0-9A-F]+)(?![0-9A-Za-z])")


@functools.lru_cache(maxsize=2)
def token_count(vocabulary: str):
    """A function from a string to its number of tokens."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary_path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def known_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def is_identifier(text: str) -> bool:
    """Digests of known length, UUIDs, and strings with fewer than two kinds of letters and digits."""
    if len(text) in DIGEST_CHARS and DIGEST.fullmatch(text) or UUID.fullmatch(text):
        return True
    kinds = (any(map(str.isdigit, text)), any(map(str.isupper, text)), any(map(str.islower, text)))
    return sum(kinds) < 2


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int]]:
    """(first, end) of all maximal scoring segments, by the linear method of Ruzzo and Tompa.

    Every positive score lies in one of them; all their beginnings and ends have positive sums.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, nearest one with less before
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, near = k, len(kept) - 1
        while True:
            while near >= 0 and kept[near][2] >= before:
                near = kept[near][4]
            if near < 0 or kept[near][3] >= total:
                break
            first, before, next_near = kept[near][0], kept[near][2], kept[near][4]
            del kept[near:]
            near = next_near
        kept.append((first, k + 1, before, total, near))
    return [(first, end) for first, end, *_ in kept]


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with blanks in place of sorted spans and of the joints beside them."""
    out, at = [], 0
    for a, b in spans:
        while a > at and text[a - 1] in JOINTS:
            a -= 1
        while b < len(text) and text[b] in JOINTS:
            b += 1
        if b > at:
            out += [text[at : max(a, at)], " " * (b - max(a, at))]
            at = b
    return "".join(out) + text[at:]


def dense_stretches(run: str, vocabulary: str, ratio: float) -> list[tuple[int, int]]:
    """Places in a run of key characters where whole parts have at most `ratio` characters per token.

    A stretch that is too short takes in parts beside it, outside of other stretches, as long as the ratio holds.
    """
    count = token_count(vocabulary)
    parts = [m.span() for m in PART.finditer(run)]
    scores = [ratio * count(run[a:b]) - (b - a) for a, b in parts]
    segments = [(0, 0), *maximal_segments(scores), (len(parts), len(parts))]
    found = []

    def place(first: int, end: int) -> tuple[int, int] | None:
        """From the first to the last part that is no joint, with a padding; None if that is no random string."""
        first += run[parts[first][0]] in JOINTS
        end -= run[parts[end - 1][0]] in JOINTS
        if end <= first:
            return None
        a, b = parts[first][0], parts[end - 1][1]
        while b < len(run) and run[b] == "=":
            b += 1
        return (a, b) if b - a >= KEY_CHARS and sum(scores[first:end]) >= 0 and not is_identifier(run[a:b]) else None

    for (_, least), (first, end), (most, _) in zip(segments, segments[1:], segments[2:]):
        wider = [(first, end)]
        if parts[end - 1][1] - parts[first][0] < KEY_CHARS + 2:
            lefts = [k for k in range(first, least - 1, -1) if parts[first][0] - parts[k][0] <= KEY_CHARS]
            rights = [k for k in range(end, most + 1) if parts[k - 1][1] - parts[end - 1][1] <= KEY_CHARS]
            wider = sorted(((x, y) for x in lefts for y in rights), key=lambda s: parts[s[1] - 1][1] - parts[s[0]][0])
        spans = (place(*w) for w in wider)
        span = next((s for s in spans if s and (not found or s[0] >= found[-1][1])), None)
        if span:
            found.append(span)
    return found


def random_spans(text: str, taken: list[tuple[int, int, str]], vocabulary: str, ratio: float) -> list[tuple[int, int, str]]:
    """Spans of key characters with at most `ratio` characters per token, outside of `taken` (sorted)."""
    found = []
    for match in KEY_LIKE.finditer(_blanked(text, [(a, b) for a, b, _ in taken])):
        run, at = match[0], match.start()
        if not is_identifier(run) and len(run) <= ratio * token_count(vocabulary)(run):
            found.append((at, match.end(), "random"))
            continue
        named = [m.span() for m in NAMED.finditer(run) if m[1] or len(m[0]) in DIGEST_CHARS]
        for part in KEY_LIKE.finditer(_blanked(run, named)):
            for a, b in dense_stretches(part[0], vocabulary, ratio):
                found.append((at + part.start() + a, at + part.start() + b, "random"))
    return found


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """One row per document: (id, spans), spans in code points, end exclusive, by start, then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = known_spans(text)
                spans += random_spans(text, spans, vocabulary, chars_per_token)
                spans.sort(key=lambda span: (span[0], KINDS.index(span[2])))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)
