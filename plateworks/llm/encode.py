"""Token ids by a public tokenizer, encoded once for each distinct word of a slice.

Exactness: the tokenizer drops white space and never joins characters across
it, so a text's ids are its words' ids in order. A final mark after a letter or
digit is a token of its own and counts as a word here. Distinct words of plain
letters give one word-end token each; they are joined by blanks and cut after
those. Other words are joined by the tokenizer's own start token, at which it
always splits.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import Text, Words

_LOADED: dict[str, object] = {}
_JOIN, _JOIN_ID, _CHUNK = "<|startoftext|>", 49406, 4000
#: Letters that no composition or contraction can change.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_FINAL = np.isin(np.arange(256), list(b".,!?;:"))
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Text bytes encoded together, and words whose ids are remembered from one slice to the next.
ENCODE_BYTES, REMEMBERED = 4 << 20, 60_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if t.token_to_id(_JOIN) != _JOIN_ID:
            raise ValueError(f"{path} lacks the token {_JOIN}")
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
        _LOADED[path] = t, ends
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    return _load(path)[0].get_vocab_size()


def _joined(t, words: list[str], sign: str) -> Iterator[np.ndarray]:
    for k in range(0, len(words), _CHUNK):
        (e,) = t.encode_batch_fast([sign.join(words[k : k + _CHUNK])], add_special_tokens=False)
        yield np.array(e.ids, np.uint32)


def _encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, and each word's first place and number of ids in them."""
    t, ends = _load(path)
    kind = np.array([0 if _PLAIN(w) else 1 if _JOIN not in w else 2 for w in words], np.int8)
    flat, count, order = [], [], []
    for k, sign in enumerate((" ", _JOIN)):
        which = np.flatnonzero(kind == k)
        order.append(which)
        for ids in _joined(t, [words[i] for i in which], sign):
            if k:
                cut = np.flatnonzero(ids == _JOIN_ID)
                count.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
                flat.append(np.delete(ids, cut))
            else:
                count.append(np.diff(np.concatenate(([-1], np.flatnonzero(ends[ids])))))
                flat.append(ids)
    order.append(np.flatnonzero(kind == 2))
    for i in order[-1]:
        flat.append(np.array(t.encode(words[i], add_special_tokens=False).ids, np.uint32))
        count.append(np.array([len(flat[-1])]))
    n, of = np.concatenate(count), np.concatenate(order)
    if len(n) != len(words):
        raise ValueError(f"{len(words)} words gave {len(n)} runs of ids")
    begin, size = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    begin[of], size[of] = np.cumsum(n) - n, n
    return np.concatenate(flat), begin, size


def _with_marks(words: Words) -> Words:
    """Words whose last mark, if a letter or digit stands before it, is a word of its own."""
    data, start, end = words.text.data, words.start, words.end
    long = np.flatnonzero(end - start > 1)
    last, before = data[end[long] - 1], data[end[long] - 2]
    lead = data[np.maximum(end[long] - 3, 0)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (end[long] - start[long] > 2)
    split = end[long[_FINAL[last] & (_ALNUM[before] | latin)]]
    at = np.sort(np.concatenate((start, split - 1)))
    return Words(words.text, at, at)


class Memory:
    """Ids of words met lately: the words of this generation, and those of the one before."""

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and each word's first place and number of ids in them."""
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        fresh = []
        for w in dict.fromkeys(words):
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    fresh.append(w)
        if fresh:
            ids, begin, size = _encode_words(fresh, path)
            raw = ids.tobytes()
            for w, at, n in zip(fresh, (4 * begin).tolist(), (4 * size).tolist(), strict=True):
                young[w] = raw[at : at + n]
        found = [young[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size, size


def _alike(words: pa.Array) -> list[str]:
    """Words without white space around them; ASCII letters lower-cased, as the tokenizer does after it has found its own signs."""
    words = pc.ascii_trim(words, " \t\n\v\f\r")
    plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<"))
    return pc.if_else(plain, pc.ascii_lower(words), words).to_pylist()


def encode(col: pa.Array, path: str, end_id: int, memory: Memory) -> Iterator[np.ndarray]:
    """Ids of each row's whole text with ``end_id`` after them; nulls are empty texts."""
    words = Text(col).words()
    if not len(words):
        for _ in range(len(col)):
            yield np.array([end_id], np.uint32)
        return
    words = _with_marks(words)
    coded = words.strings().dictionary_encode()
    which = coded.indices.to_numpy()
    ids, begin, size = memory.ids(_alike(coded.dictionary), path)
    each = size[which]
    # The ids of all words in order: word k takes ids[begin[which[k]]:][:each[k]].
    ends = np.cumsum(each)
    kind = np.int32 if max(ends[-1], len(ids)) < 1 << 31 else np.int64
    at = np.arange(ends[-1], dtype=kind)
    at += np.repeat((begin[which] - (ends - each)).astype(kind), each)
    flat = ids[at]
    bounds = np.concatenate(([0], ends))[words.first]
    last = np.array([end_id], np.uint32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.concatenate((flat[a:b], last))
