"""Secrets in texts: fixed shapes, and random strings that a vocabulary cannot compress.

Three shapes are found by pattern: a value assigned to a telling name, an access
key id, a run of hexadecimal digits. Beyond these, a run of letters, digits and
base64 signs is measured in characters per token of a byte-pair vocabulary.
Language and names take few tokens; a random string takes one for every two
characters or fewer. Runs that are random by nature but no secret are passed over
first: digests of known lengths, UUIDs, numbers, and identifiers made of words. A run
without digits, or a long word within an identifier, may be a rare word or camel case
as well, so it counts as random under a stricter ratio, and only with many letters.

Spans are in code points with the end exclusive. Defined cases: a null or empty text
has no spans. Repeated rows are scanned separately. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import per_text

# The shapes, with the least length of a match (of the value, for an assignment).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDS_JOINED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*|[-_/+=]+")
LONG_WORD = re.compile(r"[A-Za-z]{20,}")
LETTERS_CHARACTERS = 2.0  # the most characters per token of a random run without digits
LETTERS_LEAST = 8  # and its least number of different letters; DNA and patterns have fewer


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    plain = run.strip("-_=+/")
    if DIGEST.fullmatch(plain) and len(plain.removeprefix("0x")) in DIGEST_LENGTHS:
        return True
    return not any(map(str.isalpha, plain)) or bool(UUID.fullmatch(plain))


def is_random(run: str, encode: Callable[[str], list[int]], most_characters: float) -> bool:
    def dense(part: str, most: float) -> bool:
        return len(part) <= most * len(encode(part))

    def dense_letters(part: str) -> bool:
        several = len({c for c in part.lower() if c.isalpha()}) >= LETTERS_LEAST
        return several and dense(part, min(most_characters, LETTERS_CHARACTERS))

    if is_known(run):
        return False
    if WORDS_JOINED.fullmatch(run):
        return any(map(dense_letters, LONG_WORD.findall(run)))
    return dense(run, most_characters) if any(map(str.isdigit, run)) else dense_letters(run)


def spans(text: str, encode: Callable[[str], list[int]], most_characters: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    starts = sorted(s for _, s, _ in found)
    reach = [0, *accumulate((e for _, _, e in sorted(found, key=lambda s: s[1])), max)]  # of the first spans by start
    random = []
    for m in RUN.finditer(text):
        start, end = m.span()
        # spans that start before the run's end, and whether one of them goes into the run
        if reach[bisect_left(starts, end)] <= start and is_random(m[0], encode, most_characters):
            random.append(("random", start, end))
    found += random
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_characters: float = 2.2,
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) per row.

    ``ranks`` and ``pattern`` are a tiktoken vocabulary and its splitting pattern; a run
    of at most ``most_characters`` characters per token counts as random, one without
    digits of at most ``LETTERS_CHARACTERS``.
    """

    def make() -> Callable:
        encode = _encoding(ranks, pattern).encode_ordinary

        def rows(i, text):
            found = spans(text, encode, most_characters)
            base = [s for s in found if s[0] != "random"]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            return [(i, *(sum(s[0] == kind for s in found) for kind in KINDS), digest, written(found))]

        return rows

    schema = "id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return per_text(docs, id_col, text_col, make, schema)
