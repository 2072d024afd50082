"""Exact token counts at every prefix of a text, by dynamic programming.

A merge vocabulary tokenises a word so that any run of the resulting tokens is
itself the tokenisation of the characters it spans. The last token of a word's
prefix therefore settles its count: one more than the count of the prefix before
that token. A token may be last when it and the last token of the prefix before it
stay apart if tokenised together. So the prefixes of a word are solved from left to
right, each with a look at the vocabulary entries that end there, and no prefix is
ever encoded as a whole.

The counts answer how many tokens the first characters of a text have, and how many
characters fit a budget, without encoding anything again.

The vocabulary is a tokenizers file of merges with an end-of-word suffix, whose
normaliser works character by character within a word and whose splitter drops
white space. Whether two tokens stay apart, and what a character is normalised to,
is asked of the library itself, once per pair and per word. Special strings in a
text are one token each, as the library's default has it.

Defined cases: a null or empty text has no tokens. Repeated rows are counted
separately. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

KEPT_BYTES = 96 * 1024 * 1024  # of words, pre-tokens and their prefixes remembered before starting anew
KEPT_PAIRS = 250_000  # the same for pairs of tokens, which are short
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*")
# Texts that normalising only puts in lower case: up to Latin Extended-A, but for one capital i.
LATIN = re.compile("[\x00-\u012f\u0131-\u017f]*")


def _latin(*kinds: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x180) if unicodedata.category(chr(c)).startswith(kinds))


def _for_latin(pattern: str) -> re.Pattern:
    """A splitting pattern with its classes of letters, numbers and spaces spelt out for Latin texts.

    The standard library's engine is several times faster and has no such classes.
    """
    for name, spelt in ((r"\p{L}", _latin("L")), (r"\p{N}", _latin("N")), (r"\s", r"\t-\r \x85\xa0")):
        pattern = pattern.replace(name, spelt)  # they stand inside brackets
    return re.compile(pattern)


_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
ALPHABET = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(_HIDDEN)}


def _pattern(pre_tokenizer: dict) -> str:
    """The splitting pattern of a tokenizers file."""
    steps = pre_tokenizer.get("pretokenizers", [pre_tokenizer])
    return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")


@lru_cache(maxsize=1)
def counts_by(path: str) -> PrefixCounts:
    """One per Python worker, so a task finds what earlier ones have solved."""
    return PrefixCounts(path)


class PrefixCounts:
    """Token counts of words and texts by one vocabulary.

    What is remembered is bounded by its size; tables start anew between two texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.closed = self.tokenizer.model  # puts the suffix on a word's last character
        self.open = BPE(vocab=model["vocab"], merges=merges)
        self.ends = {t[: -len(self.suffix)] for t in model["vocab"] if t.endswith(self.suffix)}
        self.inner = {t for t in model["vocab"] if not t.endswith(self.suffix)}
        self.longest = max(map(len, self.ends | self.inner))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.split = regex.compile(_pattern(spec["pre_tokenizer"]))
        self.split_latin = _for_latin(_pattern(spec["pre_tokenizer"]))
        self.counts: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.pieces: dict[str, tuple[list[int], list[str]]] = {}
        self.apart_inside: dict[tuple[str, str], bool] = {}
        self.apart_at_end: dict[tuple[str, str], bool] = {}
        self.held = 0  # bytes of the tables, about
        self.before: tuple[str, list[int], list[str]] = ("", [0], [""])

    def make_room(self) -> None:
        if self.held > KEPT_BYTES:
            self.words.clear()
            self.counts.clear()
            self.pieces.clear()
            self.held = 0

    def ask(self, left: str, right: str, last: bool) -> bool:
        """Whether two tokens stay apart when tokenised together."""
        known = self.apart_at_end if last else self.apart_inside
        if len(known) > KEPT_PAIRS:
            known.clear()
        found = (self.closed if last else self.open).tokenize(left + right)
        want = right + self.suffix if last else right
        answer = known[left, right] = len(found) == 2 and found[0].value == left and found[1].value == want
        return answer

    def prefixes(self, piece: str, keep: bool = True) -> tuple[list[int], list[str]]:
        """For each prefix of a pre-token, as the start of a longer one: its tokens and the last of them.

        Without ``keep`` the table is not remembered, for callers that remember what they read from it.
        """
        found = self.pieces.get(piece)
        if found is not None:
            return found
        # where it begins as the pre-token before it did, so do their tables
        before, counts, lasts = self.before
        same = 0
        for a, b in zip(piece[:-1], before[:-1]):
            if a != b:
                break
            same += 1
        counts, lasts = counts[: same + 1], lasts[: same + 1]
        inner, apart, longest = self.inner, self.apart_inside, self.longest
        for end in range(same + 1, len(piece)):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in inner:
                    if start:
                        left = lasts[start]
                        ok = apart.get((left, token))
                        if not (self.ask(left, token, False) if ok is None else ok):
                            continue
                    counts.append(counts[start] + 1)
                    lasts.append(token)
                    break
            else:
                raise ValueError("a character is not in the vocabulary")
        self.before = piece, counts, lasts
        if keep:
            self.held += 400 + 100 * len(piece)
            self.pieces[piece] = counts, lasts
        return counts, lasts

    def closed_at(self, piece: str, end: int, keep: bool = True) -> int:
        """Tokens of ``piece[:end]`` as a whole word, from the table of prefixes."""
        if not end:
            return 0
        counts, lasts = self.prefixes(piece, keep)
        for start in range(max(0, end - self.longest), end):
            token = piece[start:end]
            if token in self.ends:
                if start:
                    ok = self.apart_at_end.get((lasts[start], token))
                    if not (self.ask(lasts[start], token, True) if ok is None else ok):
                        continue
                return counts[start] + 1
        raise ValueError("a character is not in the vocabulary")

    def pre_tokens(self, text: str) -> list[str]:
        """The words and signs of a text without special strings, in the vocabulary's alphabet."""
        if PLAIN.fullmatch(text):  # nothing to compose, and one lower-case form each
            return [p.encode().decode("latin-1").translate(ALPHABET) for p in self.split.findall(text.lower())]
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def of_plain(self, text: str) -> int:
        return sum(self.closed_at(p, len(p), keep=False) for p in self.pre_tokens(text))

    def of_word(self, word: str) -> int:
        """Tokens of a run without spaces; the prefix table of each of its parts is kept."""
        known = self.words.get(word)
        if known is None:
            self.held += 150 + 2 * len(word)
            parts = self.special.split(word) if self.special else [word]
            known = self.words[word] = sum(1 if k % 2 else self.of_plain(p) for k, p in enumerate(parts) if p)
        return known

    def is_latin(self, text: str) -> bool:
        return bool(LATIN.fullmatch(text)) and not (self.special and self.special.search(text))

    def learn(self, pieces: Iterable[str]) -> None:
        """Count the tokens of new pre-tokens of Latin texts in lower case; in order, as neighbours share their prefixes."""
        known = self.counts
        for mapped, piece in sorted((p.encode().decode("latin-1").translate(ALPHABET), p) for p in pieces if p not in known):
            known[piece] = self.closed_at(mapped, len(mapped), keep=False)
            self.held += 150 + 2 * len(piece)

    def of_latin(self, text: str) -> int:
        """Tokens of a Latin text in lower case, from its pre-tokens."""
        pieces = self.split_latin.findall(text)
        self.learn(set(pieces))
        return sum(map(self.counts.__getitem__, pieces))

    def learn_words(self, texts: list[str]) -> None:
        """Count the tokens of all new words of some Latin texts, so that their tables only look them up."""
        self.make_room()
        known, split = self.words, self.split_latin.findall
        new = {w for t in texts if self.is_latin(t) for w in t.lower().replace("\n", " ").split(" ")} - known.keys()
        parts = {w: split(w) for w in new}
        self.learn({p for ps in parts.values() for p in ps})
        counts = self.counts
        for word, ps in parts.items():
            known[word] = sum([counts[p] for p in ps])
            self.held += 150 + 2 * len(word)

    def at_words(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the words (in code points) and the tokens up to each."""
        ends, totals = self.word_table(text)
        return ends.tolist(), totals.tolist()

    def word_table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same as arrays. A word is what lies between spaces and line ends; each distinct one is solved once."""
        words = text.replace("\n", " ").split(" ")
        size = np.fromiter(map(len, words), np.int64, len(words))
        if self.is_latin(text):
            known = self.words
            words = text.lower().replace("\n", " ").split(" ")
            if not all(map(known.__contains__, words)):
                self.learn_words([text])
            count = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        else:
            count = np.fromiter((self.of_word(w) if w else 0 for w in words), np.int64, len(words))
        there = size > 0
        return (np.cumsum(size + 1) - 1)[there], np.cumsum(count)[there]

    def total(self, text: str) -> int:
        self.make_room()
        if self.is_latin(text):
            return self.of_latin(text.lower())
        return sum(map(self.of_word, filter(None, text.replace("\n", " ").split(" "))))

    def at_every_character(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ... text[:len(text)]."""
        out, at, n = [0], 0, 0
        for gap, word in re.findall("([ \n]*)([^ \n]*)", text):
            out += [n] * len(gap)
            out += [n + c for c in self.inside(word)[1:]]
            n = out[-1]
        return out

    def inside(self, word: str) -> list[int]:
        """Tokens of every prefix of a run without spaces.

        The stored prefixes serve where a character is one sign of the vocabulary's
        alphabet; a word with others, or with a special string, is counted prefix by
        prefix (from the stored prefixes of its parts).
        """
        if word.isascii() and word.isalpha():
            (piece,) = self.pre_tokens(word)
            return [self.closed_at(piece, k) for k in range(len(word) + 1)]
        return [self.of_word(word[:k]) if k else 0 for k in range(len(word) + 1)]


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, ends, totals) per row: the tokens of the text up to the end of every word.

    Stored, this answers how many tokens a text has, how many a prefix has, and which
    prefix fits a budget, and no text is encoded again.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("ends", pa.list_(pa.int32())), ("totals", pa.list_(pa.int32()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_by(tokenizer)
        for big in batches:
            for first in range(0, big.num_rows, 1000):
                batch = big.slice(first, 1000)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                counts.learn_words(texts)
                found = [counts.word_table(t) for t in texts]
                cuts = pa.array(np.cumsum([0, *(len(e) for e, _ in found)]).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in (0, 1)
                ]
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                columns = [c.cast(f.type) for c, f in zip([batch.column(0), size, *lists], schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return slim.mapInArrow(run, "id long, n_bytes long, ends array<int>, totals array<int>")


def n_tokens() -> Column:
    """Tokens of the whole text, from the columns of ``prefix_tables``."""
    return F.coalesce(F.try_element_at("totals", F.lit(-1)), F.lit(0)).cast("long")


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prefixes: str = "none"
) -> DataFrame:
    """(id, n_bytes, n_tokens[, ends, totals]) per row.

    ``totals[k]`` is the number of tokens of the text up to ``ends[k]`` code points: for
    the end of every word with ``prefixes="words"``, for every prefix (``ends`` is
    0, 1, 2 ...) with ``"characters"``.
    """

    def make() -> Callable:
        counts = counts_by(tokenizer)

        def rows(i, text):
            size = len(text.encode("utf-8", "surrogatepass"))
            if prefixes == "none":
                return [(i, size, counts.total(text))]
            if prefixes == "words":
                ends, totals = counts.at_words(text)
                return [(i, size, totals[-1] if totals else 0, ends, totals)]
            totals = counts.at_every_character(text)
            return [(i, size, totals[-1], list(range(len(totals))), totals)]

        return rows

    schema = "id long, n_bytes long, n_tokens long"
    return per_text(docs, id_col, text_col, make, schema + ", ends array<int>, totals array<int>" * (prefixes != "none"))


def tokens_of_prefix(n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from the columns of ``count_tokens(prefixes="characters")``."""
    return F.try_element_at("totals", F.least(F.greatest(n_chars, F.lit(0)), F.size("totals") - 1) + 1)


def fits_budget(budget: int) -> Column:
    """The longest prefix, in characters among ``ends``, of at most ``budget`` tokens; no text is encoded."""
    # a longer prefix can have fewer tokens where it completes a word
    fitting = F.filter(F.arrays_zip("ends", "totals"), lambda p: p["totals"] <= budget)
    longest = F.array_max(F.transform(fitting, lambda p: p["ends"]))
    whole = F.try_element_at("totals", F.lit(-1)) <= budget
    return F.coalesce(F.when(whole, F.try_element_at("ends", F.lit(-1))).otherwise(longest), F.lit(0))
