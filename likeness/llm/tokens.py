"""Token ids of whole texts, with the words of a task encoded once each.

Both vocabularies encode a text piece by piece, and no piece crosses the places where a
text is cut here: before a single space, around a single newline, and between Latin
letters and the punctuation that ends a word. So each distinct word goes through the
tokenizer's model once, and the ids of the text are those of its words. Texts where that
does not hold for certain (two white-space characters in a row, other white space than
space and newline, strings of added tokens) go through the tokenizer whole, as do words
of other letters.
"""

from __future__ import annotations

import sys
from array import array

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space other than space and newline, and what else keeps a text whole.
BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
WHOLE = (*BLANKS, "  ", " \n", "\n ", "\n\n", "<|")
# Words a worker remembers in each of two generations, at about 230 bytes a word.
REMEMBERED = 450_000
# Longer words are rare and not remembered, so that memory is bounded.
LONGEST = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """Word to ids, as bytes; words not used for a whole generation are forgotten."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        if len(word) > LONGEST:
            return found
        if len(self) >= REMEMBERED:
            self.older = self.copy()
            self.clear()
        self[word] = found
        return found


class Encoder:
    """``ids(text)`` gives a text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.keeps_case = self.tokenizer.normalizer is None
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {}
        # Words after a space, and words at the start of a line. Where white space is
        # dropped they are the same.
        self.spaced = Memory(lambda word: self.word(word, " "))
        self.bare = Memory(lambda word: self.word(word, "")) if self.keeps_case else self.spaced

    def whole(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return pack(found.ids)

    def word(self, word: str, space: str) -> bytes:
        letters = word.rstrip(".,!")
        # Letters of the Latin-1 block; every Unicode version calls them letters.
        if not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0100"):
            return self.whole(space + word)
        if marks := word[len(letters) :]:
            if marks not in self.marks:
                if len(self.marks) > 1000:
                    self.marks = {}
                self.marks[marks] = self.whole(marks)
            return (self.spaced if space else self.bare)[letters] + self.marks[marks]
        if self.keeps_case:
            letters = space + letters
        elif letters != (lowered := letters.lower()):
            return self.spaced[lowered]
        # One run of letters is one piece, here in the model's own spelling.
        spelled = letters.encode().decode("latin-1").translate(self.letters)
        return pack([token.id for token in self.model.tokenize(spelled)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[-1] in " \n" or any(map(text.__contains__, WHOLE)):
            return self.whole(text)
        found, newline = [], self.bare["\n"]
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            if words[0]:
                found.append(bare(words[0]))
            found.extend(map(spaced, words[1:]))
            found.append(newline)
        found.pop()
        return b"".join(found)


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise TypeError("this platform has no 4-byte unsigned int")
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary, with what it remembers from earlier tasks."""
    kept = sys.__dict__.setdefault("kept_encoders", {})
    if name not in kept:
        kept[name] = Encoder(name)
    return kept[name]
