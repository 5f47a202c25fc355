"""Whole-text encoders for tasks: exact ids of a public tokenizer file, encoding each distinct
chunk of text once where the tokenizer's own splitting makes chunks independent."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: How the last token of a word ends in the vocabulary; words encoded as one text.
WORD_END, TOGETHER = "</w>", 64
#: How the vocabulary of bytes writes a space.
SPACE_BYTE = "\u0120"
#: A chunk table forgets the older half beyond this many entries (about 100 MB a worker).
CHUNKS = 300_000


class Chunks:
    """chunk -> packed ids, with two generations: what was used since the last turn is kept."""

    def __init__(self, encode, most: int = CHUNKS):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.encode, self.most = encode, most

    def ensure(self, chunks: set[str]) -> dict[str, bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        missing = []
        for c in chunks.difference(self.new):
            if (known := self.old.get(c)) is None:
                missing.append(c)
            else:
                self.new[c] = known
        if missing:
            self.new.update(zip(missing, self.encode(missing), strict=True))
        return self.new


#: In Latin-1 text without these, a full stop or comma is a token of its own. White space is what the
#: tokenizer takes for it: Python's class also has the separators U+001C to U+001F.
_MARK = r"[^\w\t-\r\x20\x85\xa0]|_"
_TOUCHING = re.compile(rf"[.,](?:{_MARK}|(?<=[^\w\t-\r\x20\x85\xa0].)|(?<=_.))", re.DOTALL)


class WordEncoder:
    """A tokenizer that drops white space and never joins over it (lower case, word ends).

    Chunks between spaces and line ends are encoded once each. Latin-1 texts are lower-cased
    first (the tokenizer does that letter by letter, and Latin-1 has nothing to compose), and
    lone full stops and commas, which are tokens of their own, are cut off the chunks. A text
    that holds one of the tokenizer's added tokens is encoded in one piece."""

    def __init__(self, path: str, added: tuple[str, ...], width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import numpy as np

        self.tokenizer, self.added, self.width = Tokenizer.from_file(path), added, width
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for v, i in vocab.items() if v.endswith(WORD_END)]] = True
        self.chunks = Chunks(self._chunks)
        self.chunks.new[""] = b""

    def _many(self, texts: list[str]) -> list[bytes]:
        return [array(self.width, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks of letters only are one word each, so many are encoded as one text and told apart
        by the word ends; the others go one by one."""
        words = [c for c in chunks if c.isalpha()]
        others = [c for c in chunks if not c.isalpha()]
        found = dict(zip(others, self._many(others), strict=True))
        lines = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = array(self.width, e.ids)
            part, raw, size = words[i * TOGETHER : (i + 1) * TOGETHER], ids.tobytes(), ids.itemsize
            ends = ((self.last[ids].nonzero()[0] + 1) * size).tolist()
            if len(ends) == len(part):
                found.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                found.update(zip(part, self._many(part), strict=True))
        return [found[c] for c in chunks]

    def _split(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        text = text.lower().replace("\n", " ")
        if not _TOUCHING.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split(" ")

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        need: set[str] = {""}
        for s in split:
            if s:
                need.update(s)
        known = self.chunks.ensure(need)
        return [self._many([t])[0] if s is None else b"".join(map(known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


class ByteEncoder:
    """Byte-level BPE whose splitter lets a space begin the piece that follows it.

    So a space between two characters that aren't white space always begins a piece, and what lies
    between such spaces is encoded once each. Whether a part is empty or has white space at an end
    is looked at when it is first met; texts with such parts keep them together with their
    neighbours. A text that holds an added token is encoded in one piece."""

    def __init__(self, path: str, added: tuple[str, ...], width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import numpy as np

        self.tokenizer, self.added, self.width = Tokenizer.from_file(path), added, width
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.first = np.zeros(max(vocab.values()) + 1, bool)
        self.first[[i for v, i in vocab.items() if v.startswith(SPACE_BYTE)]] = True
        self.chunks = Chunks(self._chunks, 2 * CHUNKS)

    def _many(self, texts: list[str]) -> list[bytes]:
        return [array(self.width, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of each part with a space before it; None for parts that mustn't stand alone. Many are
        encoded as one text and told apart by the tokens that begin with a space."""
        found: dict[str, bytes | None] = {}
        words = []
        for c in chunks:
            if self._ragged(c):
                found[c] = None
            else:
                words.append(c)
        lines = [" " + " ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = array(self.width, e.ids)
            part, raw, size = words[i * TOGETHER : (i + 1) * TOGETHER], ids.tobytes(), ids.itemsize
            starts = (self.first[ids].nonzero()[0] * size).tolist()
            if len(starts) == len(part) and not starts[0]:
                found.update(zip(part, (raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)), strict=True))
            else:
                found.update(zip(part, self._many([" " + c for c in part]), strict=True))
        return [found[c] for c in chunks]

    @staticmethod
    def _ragged(part: str) -> bool:
        """Empty, or with white space (or what some tables call so) at an end."""
        return not part or part[0].isspace() or part[-1].isspace() or "\u180e" in (part[0], part[-1])

    def _together(self, parts: list[str]) -> bytes:
        """Parts with ragged ones kept beside their neighbours."""
        out = [parts[0]]
        for before, p in zip(parts, parts[1:], strict=False):
            if self._ragged(p) or self._ragged(before):
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return b"".join(self._many(out))

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [None if any(a in t for a in self.added) else t.split(" ") for t in texts]
        need: set[str] = set()
        for s in split:
            if s:
                need.update(s)
        known = self.chunks.ensure(need)
        out = []
        for t, s in zip(texts, split, strict=True):
            if s is None:
                out += self._many([t])
                continue
            ids = list(map(known.__getitem__, s))
            if None in ids:
                out.append(self._together(s))
            else:
                ids[0] = self._many([s[0]])[0]
                out.append(b"".join(ids))
        return out


def _added(path: str) -> tuple[tuple[str, ...], int]:
    """Added tokens and the number of ids."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return tuple(a.content for a in t.get_added_tokens_decoder().values()), t.get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=4)
def encoder(name: str, folder: str | None = None):
    """The encoder of a tokenizer file, once per Python worker. name: word_bpe_49k.json or
    byte_bpe_50k.json; folder: where the files lie (None: the installed public_tokenizers)."""
    import public_tokenizers

    path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
    added, size = _added(path)
    width = "H" if size <= 1 << 16 else "I"
    if name.startswith("byte_bpe_50k"):
        return ByteEncoder(path, added, width)
    return WordEncoder(path, added, width)
