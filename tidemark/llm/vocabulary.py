"""Token ids of whole texts by a byte-level vocabulary in a tokenizers file."""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Characters on whose classes the two libraries cannot differ: up to Latin Extended-B.
LATIN = re.compile("[\x00-ɏ]*")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(_HIDDEN)}


class IdsOf:
    """The ids of a text as little-endian 32-bit numbers.

    A vocabulary whose entries are numbered in the order of their merges can be
    encoded by tiktoken as well, several times faster than by tokenizers; texts in
    Latin letters go that way, with the ranks taken from the same file. ``pattern`` is
    the vocabulary's splitting pattern. Any other text, or vocabulary, goes through
    tokenizers, and so does a text that tiktoken refuses: its splitting gives up on a
    run of about a million white-space characters.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary, model = spec["model"]["vocab"], spec["model"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        in_order = merged == sorted(merged) and len(vocabulary) == len(merged) + 256
        plain = spec["normalizer"] is None and not (model["end_of_word_suffix"] or model["continuing_subword_prefix"])
        self.encoding = None
        if in_order and plain:
            self.encoding = tiktoken.Encoding(
                "ranks",
                pat_str=pattern,
                mergeable_ranks={bytes(BYTE_OF[c] for c in token): rank for token, rank in vocabulary.items()},
                special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
            )

    def __call__(self, text: str) -> bytes:
        if self.encoding and LATIN.fullmatch(text):
            try:
                return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
