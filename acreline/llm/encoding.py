"""Token ids of whole texts, word by word, from a public tokenizer file.

The tokenizer (`tokenizers` JSON) must drop white space and never let a token span it,
as word-level BPE with word ends does; `check_splittable` refuses others. Then the ids of
a text are those of its white-space words, one after the other: white space is a safe
boundary. A word is encoded once per Python worker and kept in a bounded memo, so the cost
follows the number of different words rather than the length of the corpus.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np

from acreline.llm.common import give_back

#: Words longer than this are encoded but not kept.
KEEP_BYTES = 64
#: Different words kept per Python worker before the memo is emptied.
KEEP_WORDS = 400_000
#: Text is taken in portions of about so many bytes.
PORTION_BYTES = 4 << 20
#: Short texts are encoded together up to so many bytes.
GROUP_BYTES = 4 << 20

# ASCII punctuation but the apostrophe. After a letter the tokenizer's own pattern always cuts
# before a run of these, so a word's letters and its tail are encoded apart.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE_AT = re.compile(rb"[\x20\x09-\x0D]")
_WORD_END = "</w>"


def check_splittable(tokenizer_json: str) -> None:
    """Raise unless white space separates tokens and is itself dropped."""
    spec = json.loads(tokenizer_json)
    if spec["model"].get("end_of_word_suffix") != _WORD_END or not spec.get("normalizer"):
        raise ValueError("not a word-level BPE with word ends; white space is no safe boundary")
    if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        raise ValueError("added tokens reach over white space")


def _letters(word: bytes) -> bool:
    return word.isalpha() or word.decode("utf-8", "replace").isalpha()


def portions(text: bytes, most: int = PORTION_BYTES) -> Iterator[bytes]:
    """Cut a long text at the first white space after every `most` bytes."""
    at = 0
    while len(text) - at > most:
        found = _SPACE_AT.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:] if at else text


class WordEncoder:
    """Ids of words as little-endian unsigned 32-bit integers, memoised."""

    def __init__(self, tokenizer_json: str, keep_words: int = KEEP_WORDS):
        from tokenizers import Tokenizer

        check_splittable(tokenizer_json)
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self._ends[i] = token.endswith(_WORD_END)
        self._added = {t["content"].encode().lower() for t in json.loads(tokenizer_json)["added_tokens"]}
        self._keep = keep_words
        self._memo: dict[bytes, bytes] = {}
        self._tails: dict[bytes, bytes] = {b"": b""}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; the caller gives them as `words` does."""
        memo = self._memo
        new = list(set(words).difference(memo))
        if new:
            self._learn(new)
        out = list(map(memo.__getitem__, words))
        if len(memo) > self._keep:
            memo.clear()
        for w in [w for w in new if len(w) > KEEP_BYTES]:
            memo.pop(w, None)
        return out

    def close(self) -> None:
        """Let go of the tokenizer and all that is memoised; what the worker has freed goes back to the system."""
        self._tokenizer = None
        self._memo.clear()
        self._tails.clear()
        give_back()

    def _learn(self, words: list[bytes]) -> None:
        memo, tails = self._memo, self._tails
        cores = [w.rstrip(_TAIL) for w in words]
        fresh = [c for c in set(cores).difference(memo) if _letters(c)]
        if fresh:
            memo.update(zip(fresh, self._single(fresh)))
        odd = []
        for word, core in zip(words, cores):
            if not _letters(core):
                odd.append(word)
            elif len(word) > len(core):
                tail = word[len(core):]
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    [tails[tail]] = self._each([tail])
                memo[word] = memo[core] + tails[tail]
        if odd:
            memo.update(zip(odd, self._each(odd)))

    def _each(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _single(self, words: list[bytes]) -> list[bytes]:
        """Words of letters only: one call for all, cut where a token ends a word."""
        text = b" ".join(words).decode("utf-8", "replace")
        [encoded] = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.asarray(encoded.ids, dtype="<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        raw, at, out = ids.tobytes(), 0, []
        for end in (ends * 4).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def words(self, text: bytes) -> list[bytes]:
        """Words in lower case, but as they are where an added token may be: these match the raw text."""
        lower = text.lower()
        if not any(a in lower for a in self._added):
            return lower.split()
        return [w if any(a in low for a in self._added) else low
                for w, low in zip(text.split(), lower.split())]

    def texts(self, texts: Iterable[bytes | None], group_bytes: int = GROUP_BYTES) -> Iterator[Iterator[bytes]]:
        """For each text the ids of its portions; several short texts share one call."""
        group, size = [], 0
        for text in texts:
            if text is not None and len(text) > PORTION_BYTES:
                yield from self._group(group)
                group, size = [], 0
                yield (b"".join(self.ids_of(self.words(p))) for p in portions(text))
                continue
            group.append(text)
            size += len(text or b"")
            if size >= group_bytes:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[bytes | None]) -> Iterator[Iterator[bytes]]:
        words = [self.words(t or b"") for t in group]
        ids = self.ids_of([w for ws in words for w in ws])
        at = 0
        for ws in words:
            end = at + len(ws)
            yield iter((b"".join(ids[at:end]),))
            at = end


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """This Python worker's encoder; it stays for the worker's later tasks."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


@contextmanager
def task_encoder(tokenizer_json: str, keep_words: int) -> Iterator[WordEncoder]:
    """An encoder for one task. Its memory goes with the task, for workers that have other work too."""
    own = WordEncoder(tokenizer_json, keep_words)
    try:
        yield own
    finally:
        own.close()


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text; a few MB, sent to the executors as one broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()
