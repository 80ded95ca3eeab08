"""Tokenizers applied word by word, cut where every tokenization is cut anyway."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

# A single space between two characters that are not white space. Byte-level tokenizers
# start a new word there and attach the space to what follows; tokenizers that drop white
# space end a word there. No special string holds a space.
_LONE_SPACE = re.compile(r" (?<=\S )(?=\S)")
# A full stop or comma between a letter and white space is a word of its own.
_STOP = re.compile(r"[.,](?<=[a-z].)(?=\s)")
# Characters whose lower case depends on their neighbours or may change their composition.
_NOT_SIMPLE = re.compile("[İɐ-\U0010ffff]")
_KNOWN_WORDS = 700_000
_KNOWN_LENGTH = 64
_JOINED = 256


def parts(text: str, chars: int) -> Iterator[str]:
    """``text`` in parts of about ``chars`` characters, cut before lone spaces.

    A stretch without a lone space stays in one part, however long.
    """
    start = 0
    while len(text) - start > chars:
        cut = _LONE_SPACE.search(text, start + chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class WordEncoder:
    """Looks words up, and encodes those it has not met in batches.

    New words are joined to longer texts, which the tokenizer encodes faster, and the result
    is cut where ``starts`` says that a word begins; if the number of cuts is not that of the
    words, they are encoded one by one. The table of known words is emptied at its bound, and
    long words are not kept, so memory stays bounded.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        # Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._value = Tokenizer.from_file(path), value
        self._known: dict[str, object] = {}
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # The narrowest unsigned integers that hold every id.
        self.id_type = np.dtype("<u2" if size <= 2**16 else "<u4")
        self._tokens = [self._tokenizer.id_to_token(i) or "" for i in range(size)]

    def values(self, texts: list[str]) -> list[list]:
        """The values of the words of each text, in order."""
        keys = [self.words(text) for text in texts]
        if len(self._known) > _KNOWN_WORDS:
            self._known.clear()
        known = self._known
        new = {word for words in keys for word in words if word not in known}
        self._learn(list(new))
        found = [[known[word] for word in words] for words in keys]
        for word in new:
            if len(word) > _KNOWN_LENGTH:
                del known[word]
        return found

    def words(self, text: str) -> list[str]:
        raise NotImplementedError

    def _learn(self, new: list[str]) -> None:
        plain = [word for word in new if self.joinable(word)]
        chunks = [plain[at : at + _JOINED] for at in range(0, len(plain), _JOINED)]
        alone = [word for word in new if not self.joinable(word)]
        for chunk, ids in zip(chunks, self._encode([self.glue.join(chunk) for chunk in chunks]), strict=True):
            cuts = np.flatnonzero(self.starts[ids]) if ids else []
            if len(cuts) != len(chunk) or cuts[0] != 0:
                alone += chunk
                continue
            ends = [*cuts[1:].tolist(), len(ids)]
            for word, a, b in zip(chunk, cuts.tolist(), ends, strict=True):
                self._known[word] = self._value(ids[a:b])
        for word, ids in zip(alone, self._encode(alone), strict=True):
            self._known[word] = self._value(ids)

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), _JOINED):
            for encoding in self._tokenizer.encode_batch_fast(texts[at : at + _JOINED], add_special_tokens=False):
                yield encoding.ids


class SpacedWords(WordEncoder):
    """For byte-level tokenizers: a word is a lone space and what follows it."""

    glue = ""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        super().__init__(path, value)
        # Byte-level vocabularies write a space as this letter.
        self.starts = np.array([token.startswith("Ġ") for token in self._tokens])

    def words(self, text: str) -> list[str]:
        first, *rest = _LONE_SPACE.split(text)
        return [first, *[" " + word for word in rest]]

    def joinable(self, word: str) -> bool:
        return word[:1] == " " and len(word) <= _KNOWN_LENGTH and len(word.split()) == 1 and not word[-1].isspace()


class LoneWords(WordEncoder):
    """For tokenizers that drop white space, ignore case and mark the ends of words."""

    glue = " "

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        super().__init__(path, value)
        ends = np.array([token.endswith("</w>") for token in self._tokens])
        self.starts = _After(ends)
        # These match in their own case only: lower-casing must not make one.
        special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE)

    def words(self, text: str) -> list[str]:
        if not _NOT_SIMPLE.search(text) and not self._special.search(text):
            text = text.lower()
        return [word for word in _STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ") if word]

    def joinable(self, word: str) -> bool:
        return word.isalpha() and len(word) <= _KNOWN_LENGTH


class _After:
    """Marks the ids that follow the end of a word, and the first."""

    def __init__(self, ends: np.ndarray):
        self._ends = ends

    def __getitem__(self, ids: list[int]) -> np.ndarray:
        marks = np.ones(len(ids), bool)
        marks[1:] = self._ends[ids][:-1]
        return marks


@functools.lru_cache(maxsize=2)
def token_lengths(path: str) -> SpacedWords:
    """Kept by the Python worker from task to task."""
    return SpacedWords(path, len)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> LoneWords:
    """Ids as little-endian integers of the encoder's ``id_type``."""
    encoder = LoneWords(path, lambda ids: np.array(ids, encoder.id_type).tobytes())
    return encoder
