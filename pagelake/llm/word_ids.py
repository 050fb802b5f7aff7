"""Texts to token ids through a memory of words: equal words are encoded once per worker.

A word is a piece of the text up to the next space that follows a non-space. No token of the tokenizers used here
spans such a cut, so the ids of a text are those of its words.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable
from itertools import accumulate, chain

import numpy as np

# Words that a worker remembers; when full it starts again. Longer words are not remembered.
WORDS_KEPT = 300_000
LONGEST_KEPT = 100
# A place where the text may be cut: before a space after a non-space.
SAFE_CUT = re.compile(r"(?<=\S)(?= )")
UNSAFE = re.compile(r"[^\S \n]| \s|\n ")
# Words that stay apart when run together: one space before, no white space at the end, no mark of a special token.
PLAIN_WORD = re.compile(r" [^\s<](?:[^<]*[^\s<])?")


def chunks(text: str) -> list[str]:
    """The text cut before each space that follows a non-space."""
    if UNSAFE.search(text):
        return SAFE_CUT.split(text)
    first, *rest = text.split(" ")
    rest = [" " + part for part in rest]
    if first:
        return [first, *rest]
    return rest or [""]


class WordIds:
    """Texts, cut into words, to their ids as little-endian unsigned 32-bit numbers. `learn` encodes a list of new words."""

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]]):
        self.learn = learn
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text. The new words of all these texts are encoded in one call."""
        words = set().union(*texts)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = list(words)
        known = self.known
        known.update(zip(new, self.learn(new)))
        found = [b"".join(map(known.__getitem__, parts)) for parts in texts]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del known[word]
        return found


def raw_ids(lists: list[list[int]]) -> list[bytes]:
    """Lists of ids as bytes each."""
    raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    ends = list(accumulate((4 * len(ids) for ids in lists), initial=0))
    return [raw[x:y] for x, y in zip(ends, ends[1:])]


def byte_level_learner(tokenizer, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[list[str]], Iterable[bytes]]:
    """Encodes new words by a byte-level tokenizer.

    With `ranks_path` (the same vocabulary as byte ranks) words are run together, encoded in one call, and
    told apart by the byte lengths of their ids, which is several times faster. Words
    that can't be run together, or may hold a special token, go to the tokenizer itself.
    """
    if not ranks_path:
        return lambda new: raw_ids([found.ids for found in tokenizer.encode_batch_fast(new, add_special_tokens=False)])
    import tiktoken

    with open(ranks_path, "rb") as lines:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    width = np.zeros(max(table.values()) + 1, np.int64)
    for word, rank in table.items():
        width[rank] = len(word)

    def learn(new: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        plain = [word for word in new if PLAIN_WORD.fullmatch(word)]
        if plain:
            ids = ranks.encode_to_numpy("".join(plain)).astype("<u4")
            ends = np.cumsum([len(word.encode()) for word in plain])
            cuts = np.searchsorted(np.cumsum(width[ids]), ends) + 1
            raw, at = ids.tobytes(), 0
            for word, cut in zip(plain, (4 * cuts).tolist()):
                found[word] = raw[at:cut]
                at = cut
        odd = [word for word in new if word not in found]
        found |= zip(odd, raw_ids([encoded.ids for encoded in tokenizer.encode_batch_fast(odd, add_special_tokens=False)]))
        return [found[word] for word in new]

    return learn


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
