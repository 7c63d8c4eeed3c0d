"""Token ids of whole texts from the library's ids of their words.

A byte-level tokenizer first cuts a text by a pattern, which takes most of its time, and no
token crosses a cut. So a worker asks the library for each word once and keeps the ids of
words in use. The ids are the library's own. Where the tokenizer file does not have the
properties this rests on, or a text holds one of its added tokens, the library gets the
whole text.

The pattern's parts never go from other characters into white space, and of several white
spaces the last belongs to what follows. So a token begins at a blank that a printing ASCII
character follows. Which other characters are letters or white space, in which version of
Unicode, does not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

# Words kept by a worker; when they are so many, the older ones go. Longer words are not kept.
KEPT_WORDS = 150_000
KEPT_CHARS = 48

BEFORE_ASCII = re.compile(r" (?=[!-~])")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class _Memo:
    """Packed ids of words, asked for once in a run of texts and kept while they are in use.

    New words that begin where a token must begin are asked for as one text, whose ids are
    cut again by the bytes they stand for: a library is slower with many short texts.
    """

    def __init__(self, ask: Callable[[list[str]], list[list[int]]], joins: Callable[[str], bool], widths: list[int]):
        self.ask, self.joins = ask, joins
        self.widths = np.array(widths, np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> dict[str, bytes]:
        together = [w for w in words if self.joins(w)]
        alone = [w for w in words if not self.joins(w)]
        found = {}
        if together:
            ids = np.array(self.ask(["".join(together)])[0], np.int32)
            ends = np.cumsum(self.widths[ids])
            cuts = np.cumsum([len(w.encode()) for w in together])
            at = np.searchsorted(ends, cuts)
            if len(ends) and at[-1] == len(ends) - 1 and np.array_equal(ends[at], cuts):
                raw, start = ids.tobytes(), 0
                for w, stop in zip(together, (4 * (at + 1)).tolist(), strict=True):
                    found[w] = raw[start:stop]
                    start = stop
            else:  # the ids do not give the text back, so they cannot be cut
                alone = words
        if alone:
            found.update((w, packed(ids)) for w, ids in zip(alone, self.ask(alone), strict=True))
        return found

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given as lists of words."""
        young, old = self.young, self.old
        wanted = set(chain.from_iterable(texts))
        wanted.difference_update(young)
        missing = [w for w in wanted if w not in old]
        young.update((w, old[w]) for w in wanted if w in old)
        if missing:
            young.update(self._new(missing))
        found = [b"".join([young[w] for w in words]) for words in texts]
        for w in wanted:
            if len(w) > KEPT_CHARS:
                del young[w]
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        return found


class ByteLevelWords:
    """Ids of a ``tokenizers`` model, as ``encode_batch(texts, add_special_tokens=False)`` gives them."""

    def __init__(self, model):
        self.model = model
        spec = json.loads(model.to_str())
        before, kind = spec["pre_tokenizer"] or {}, spec["model"]
        # Special tokens are ordinary text where the model says so; other added ones never are.
        self.added = [t["content"] for t in spec["added_tokens"] if not (t["special"] and model.encode_special_tokens)]
        self.by_word = (
            spec["normalizer"] is None and spec["truncation"] is None and spec["padding"] is None
            and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and kind["type"] == "BPE" and not kind.get("dropout") and not any(" " in a for a in self.added)
        )
        widths = [0] * model.get_vocab_size(with_added_tokens=True)
        for token, i in model.get_vocab(with_added_tokens=True).items():
            widths[i] = len(token)  # a character stands for a byte
        self.memo = _Memo(self._ask, lambda w: w[:1] == " ", widths)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The packed 32-bit ids of each text."""
        if not self.by_word:
            return [packed(ids) for ids in self._ask(texts)]
        added = self.added
        whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        words = []
        for text in texts:
            first, *rest = BEFORE_ASCII.split(text)
            words.append([first, *[" " + w for w in rest]] if first else [" " + w for w in rest])
        for i in whole:
            words[i] = []
        found = self.memo.of(words)
        for i, ids in zip(whole, self._ask([texts[i] for i in whole]) if whole else [], strict=True):
            found[i] = packed(ids)
        return found


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Packed ids of many texts as one Arrow array."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
