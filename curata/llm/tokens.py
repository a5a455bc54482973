"""Whole-text encoding with the tokenizers library, for use inside Spark's Python workers.

The vocabulary drops white space, and none of its patterns crosses it, so a text's ids are
those of its words in order. Each worker keeps the ids of the words that it meets often (at
most ``CACHE_WORDS``), and the library encodes the others. So that more words are met again, ASCII letters are
lower-cased first, as the vocabulary does.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from curata.llm.common import worker_state

#: Id appended to each document.
END_ID = 1
#: Words whose ids a worker keeps: about 250 bytes each.
CACHE_WORDS = 500_000

# A word of Latin letters, of those that stay single in lower case, and ASCII marks after it but for the
# apostrophe: the vocabulary's pattern parts it into just these two pieces.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others, in order, for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # a vocabulary that keeps white space would join words; such texts are encoded whole
        ids = self._ids(["one two", "one", "two", "one \n two"])
        self.by_word = ids[0] == ids[1] + ids[2] == ids[3]
        # a word of the plain form goes to the model itself, if this vocabulary lower-cases and maps bytes to letters
        self.plain = [self._pieces(w) for w in ("Größe", "Été,", "ABC!?")] == self._ids(["Größe", "Été,", "ABC!?"])
        self.plain &= self._ids(["it's a-b. so", "IT'S A-B. SO"]) == self._ids(["it's a-b. so"]) * 2
        self.words = _Words(self, {})

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _pieces(self, word: str) -> bytes:
        stem, marks = _PLAIN.fullmatch(word).groups()
        return self._piece(stem.lower()) + (self._piece(marks) if marks else b"")

    def _folded(self, text: bytes) -> bytes:
        """A text with the same ids of fewer different words. Special tokens are left alone, and so are texts with combining
        marks (U+0300 to U+037F), which can compose with a small letter where they can't with its capital."""
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text, without the end id."""
        if not self.by_word:
            return self._ids([(t or b"").decode() for t in texts])
        if len(self.words) > CACHE_WORDS // 2:
            # words of the last generation that occur again move over; the others go with the next change
            self.words = _Words(self, self.words)
        get = self.words.__getitem__
        folded = self._folded if self.plain else bytes
        # bytes.split() parts at exactly space, tab, line feed, vertical tab, form feed and carriage return
        return [b"".join(map(get, folded(t).split())) if t else b"" for t in texts]


class _Words(dict):
    """The ids of words, which are looked up once: in the generation before, else in the library."""

    def __init__(self, encoder: WordEncoder, before: dict[bytes, bytes]):
        super().__init__()
        self.encoder, self.before = encoder, dict(before)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            encoder = self.encoder
            if encoder.plain and word.isalpha():  # ASCII letters alone
                ids = self[word] = encoder._piece(word.decode().lower())
                return ids
            text = word.decode()
            match = _PLAIN.fullmatch(text) if encoder.plain else None
            if match is None:
                ids = encoder._ids([text])[0]
            else:
                stem, marks = match.groups()
                stem = stem.lower()
                key = stem.encode()
                ids = encoder._piece(stem) if key == word else self[key]
                if marks:
                    ids += encoder._piece(marks)
        self[word] = ids
        return ids


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    state = worker_state("tokens")
    key = ("encoder", path)
    if key not in state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state[key] = WordEncoder(path)
    return state[key]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_batches(batches, column: str = "text", rows: int = 256, chars: int = 8 << 20):
    """Slices of Arrow batches of at most ``rows`` rows and, but for a single longer text, ``chars`` bytes of
    text, each as (slice, its texts as bytes)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + chars, side="right"))))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop
