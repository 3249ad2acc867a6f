"""Fast exact encoding of whole texts with the ``tokenizers`` library.

The library spends about two microseconds on every word, also on those it has met before.  Both public
vocabularies used here split a text into words before merging, and no word crosses a single blank between two
characters that are not white space.  So a text is cut at blanks, the ids of each piece are kept, and only pieces
not met before go through the library, many in one call.  Texts with runs of white space around a blank are encoded
whole by the library.  The result equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` in every case;
strings that spell special tokens are ordinary text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

KEPT_PIECES = 800_000  # pieces kept in a worker; beyond that the table starts anew (about 150 MB)
JOINED_PIECES = 100  # pieces in one call of the library
STOPS = ",."
SEPARATOR = "|"  # a word of its own between the pieces, for vocabularies whose ids don't show where a piece starts


def public_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes texts as little-endian ids of ``dtype``; one per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.pieces: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes | None] = {}
        #: byte-level words that follow a blank begin with this letter
        self.starts = self.ends = None
        if self.ids(" a b") != self.ids("a b"):
            self.starts = np.zeros(size, bool)
            self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        else:
            (self.mark,) = self.ids(SEPARATOR)
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        #: a line's first word is a piece with its line end, or like any word where line ends leave no ids
        self.line = " \n" if self.ids("\n") else " "
        self.newline = (self.ids("\n") or [-1])[0]

        #: the vocabulary has lower case only
        self.folds = self.ids("Ab É") == self.ids("ab é")
        self.stops = {c: self.whole(c) for c in STOPS}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), self.dtype).tobytes()

    def learn(self, new: list[str]) -> None:
        """Keeps the ids of pieces not met before; None for a piece beside more white space."""
        kept, lines, plain, letters, stopped = self.pieces, [], [], [], []
        for p in new:
            if p and p[-1] in STOPS and p[:-1].isalpha():  # letters, then a mark: always two words of their own
                stopped.append(p)
                if p[:-1] not in kept:
                    (plain if self.ends is None else letters).append(p[:-1])
                continue
            bare = p[1:] if p[:1] == "\n" else p
            if not bare or bare[0].isspace() or bare[-1].isspace():
                kept[p] = None
            elif bare is not p:
                lines.append(p)
            elif self.starts is None and SEPARATOR in p:
                kept[p] = self.whole(p)
            elif self.ends is not None and p.isalpha():  # one word of the vocabulary, so one end of a word
                letters.append(p)
            else:
                plain.append(p)
        plain = list(dict.fromkeys(plain))
        for part in (plain[k : k + JOINED_PIECES] for k in range(0, len(plain), JOINED_PIECES)):
            if self.starts is not None:
                self.keep(part, " " + " ".join(part), lambda ids: self.starts[ids], " ", 0)
            else:
                self.keep(part, f"{SEPARATOR} " + f" {SEPARATOR} ".join(part), lambda ids: ids == self.mark, "", 1)
        letters = list(dict.fromkeys(letters))
        for part in (letters[k : k + JOINED_PIECES] for k in range(0, len(letters), JOINED_PIECES)):
            self.keep(part, " ".join(part), lambda ids: np.append(True, self.ends[ids[:-1]]) if len(ids) else np.zeros(0, bool), "", 0)
        for part in (lines[k : k + JOINED_PIECES] for k in range(0, len(lines), JOINED_PIECES)):
            self.keep(part, "".join(part), lambda ids: ids == self.newline, "", 0)
        kept.update({p: kept[p[:-1]] + self.stops[p[-1]] for p in stopped})

    def keep(self, part: list[str], joined: str, begins, before: str, skipped: int) -> None:
        ids = np.array(self.ids(joined), self.dtype)
        cut = np.flatnonzero(begins(ids))
        if len(cut) != len(part):  # never met; the library alone decides then
            self.pieces.update({p: self.whole(before + p) for p in part})
            return
        raw, w, ends = ids.tobytes(), self.dtype.itemsize, [*cut[1:].tolist(), len(ids)]
        self.pieces.update({p: raw[(a + skipped) * w : b * w] for p, a, b in zip(part, cut.tolist(), ends)})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, null as the empty text."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if self.folds:
                text = folded(text)
            first, *rest = (text.replace("\n", self.line) if "\n" in text else text).split(" ")
            found = list(map(self.pieces.get, rest))
            if None in found:
                if len(self.pieces) > KEPT_PIECES:
                    self.pieces.clear()
                    found = [None] * len(rest)
                at, missing = -1, []
                try:
                    while True:
                        missing.append(at := found.index(None, at + 1))
                except ValueError:
                    pass
                self.learn(list({rest[i] for i in missing}))
                for i in missing:
                    found[i] = self.pieces[rest[i]]
            if (head := self.firsts.get(first)) is None:
                safe = first and not first[0].isspace() and not first[-1].isspace()
                head = self.whole(first) if safe else None
                if len(self.firsts) < KEPT_PIECES // 10:
                    self.firsts[first] = head
            out.append(self.whole(text) if head is None or None in found else head + b"".join(found))
        return out


def folded(text: str) -> str:
    """The text in lower case where that changes one character at a time, so fewer pieces differ; else as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The process's own encoder of a vocabulary file."""
    return PieceEncoder(path)
