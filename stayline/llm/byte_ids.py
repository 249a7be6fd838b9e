"""Token ids of a byte-level BPE file, a space-separated unit at a time.

The file's pre-tokenizer never joins text across a space that is followed by a
non-space, so a text falls into units there, and the ids of a text are the ids of its
units in order. Units repeat, so each process keeps a bounded table from unit to ids and
sends only unknown units to the tokenizers library. Special strings hold no space, and
a unit that contains one goes through the library like any other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: How the library's byte-level pre-tokenizer cuts a text into pieces (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this one are letters, numbers or white space alike in every version of Unicode tables.
_BEYOND = "\u0250"
_BEFORE_SPACE = re.compile(r"(?= \S)")
_STOPS = ".,;:!?"
_SPACE_RUN = re.compile(r" (?:\s|$)")
#: A long unit is encoded anew each time; with the entry limit this bounds the table's memory.
LONGEST_KEPT, MOST_KEPT = 64, 1_000_000
#: Characters that are split at a time.
LONGEST_ROW = 1 << 22


def _bytes_of_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(tokenizer) -> tiktoken.Encoding | None:
    """A quicker encoder with the same ids for texts below `_BEYOND`; None where that isn't certain.

    It merges any neighbours that make a token, lowest id first; the library merges the listed pairs in their
    order. Both do the same if ids rise in the order of the pairs and the library gives each token
    itself for its own string: until a token is made, what is inside it merges as it does when it stands alone,
    so no other pair than the listed one ever meets.
    """
    own, letters = json.loads(tokenizer.to_str()), _bytes_of_letters()
    model, cuts = own["model"], own["pre_tokenizer"] or {}
    plain = (own["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex")
             and not cuts.get("add_prefix_space") and model["type"] == "BPE" and not model["dropout"]
             and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"])
    vocab = model["vocab"] if plain else {}
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model.get("merges", [])]
    made = [vocab.get("".join(p), -1) for p in pairs]
    whole = set(letters) <= vocab.keys() and all(set(t) <= letters.keys() for t in vocab)
    if not whole or -1 in made or any(a >= b for a, b in pairwise(made)):
        return None
    if any([x.id for x in tokenizer.model.tokenize(token)] != [at] for token, at in vocab.items()):
        return None
    ranks = {bytes(map(letters.__getitem__, token)): at for token, at in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _near(word: str) -> bool:
    """Whether a word is short and below `_BEYOND`."""
    return len(word) <= LONGEST_KEPT and (word.isascii() or max(word) < _BEYOND)


def units(text: str) -> list[str]:
    """Pieces whose ids concatenate to the ids of the text; joined they are the text."""
    if _SPACE_RUN.search(text):
        return _BEFORE_SPACE.split(text)
    first, *rest = text.split(" ")
    found = [" " + x for x in rest]
    return [first, *found] if first else found


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizers library does.

    In a text where no space is followed by white space, the units after the first are the words between
    its spaces, each with a space before it; `known` has the ids of such a unit under its word. Arrow splits
    many texts at a time and numbers their distinct words, so that Python looks at each of those once, and
    puts their ids together again.
    Other texts, and those with a special string, are looked at unit by unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.quick = ranked(self.tokenizer)
        self.mark = "<|endoftext|>"
        self.spaced = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.spaced[at] = token.startswith("\u0120")  # how byte-level vocabularies write a space
        self.known: dict[str, bytes] = {"": b""}
        self.alone: dict[str, bytes] = {}

    def _encode(self, text: str, near: bool) -> np.ndarray:
        """Ids of a text; `near`: it is made of near words."""
        if near and self.quick:
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets

    def _alone(self, unit: str) -> bytes:
        return self._encode(unit, _near(unit) and self.mark not in unit).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of words with a space before them into the table, some to a call.

        Stops behind a letter are a token run of their own, so such a word has the ids of the word without
        them and those of the stops. The other units have one token that begins with a space, their first;
        they are run together and their ids cut before such tokens.
        """
        known, todo, later = self.known, {}, []
        for word in words:
            bare = word.rstrip(_STOPS)
            if len(bare) == len(word) or not bare or not bare[-1].isalpha():
                todo[word] = None
            elif bare in known:
                known[word] = known[bare] + self._kept_alone(word[len(bare):])
            else:
                todo[bare] = None
                later.append((word, bare))
        kinds = [[w for w in todo if _near(w)], [w for w in todo if not _near(w)]]
        for near, part in ((k == 0, kinds[k][i:i + 64]) for k in (0, 1) for i in range(0, len(kinds[k]), 64)):
            ids = self._encode(" " + " ".join(part), near)
            cuts = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            raw = ids.tobytes()
            known.update(zip(part, [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        for word, bare in later:
            known[word] = known[bare] + self._kept_alone(word[len(bare):])

    def _kept_alone(self, run: str) -> bytes:
        """Ids of stops, or of a text's first word: nothing before them matters."""
        ids = self.alone.get(run)
        if ids is None:
            ids = self._alone(run)
            if len(self.alone) < 100_000 and len(run) <= LONGEST_KEPT:
                self.alone[run] = ids
        return ids

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words with a space before them, none for an empty one; the table keeps the words
        of the last call at least."""
        ids = list(map(self.known.get, words))
        at = [i for i, own in enumerate(ids) if own is None]
        if not at:
            return ids
        if len(self.known) + len(at) > MOST_KEPT:
            self.known = {w: own for w, own in zip(words, ids, strict=True) if own is not None} | {"": b""}
        new = [words[i] for i in at]
        self._learn(new)
        for i in at:
            ids[i] = self.known[words[i]]
        for word in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.known[word]
            if len(bare := word.rstrip(_STOPS)) > LONGEST_KEPT:
                self.known.pop(bare, None)
        return ids

    def _odd(self, text: str) -> bytes:
        """A text in which units are not all a space and a word."""
        split = units(text)
        plain = [u.rfind(" ") == 0 and len(u) > 1 and not u[1].isspace() and self.mark not in u for u in split]
        words = list({u[1:] for u, p in zip(split, plain, strict=True) if p})
        ids = dict(zip(words, self._ids_of(words), strict=True))
        return b"".join([ids[u[1:]] if p else self._alone(u) for u, p in zip(split, plain, strict=True)])

    def _rows(self, rows: list[str], begins: list[bool]) -> list[bytes]:
        """Plain texts, or parts of them behind a space; `begins` marks the beginnings of texts."""
        split = pc.split_pattern(pa.array(rows, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        of = coded.indices.to_numpy().copy()
        offsets = split.offsets.to_numpy()
        heads = offsets[:-1][begins]
        spaced = np.ones(len(of), bool)
        spaced[heads] = False
        first_words = {int(w): words[w] for w in of[heads].tolist()}
        for at in np.flatnonzero(np.bincount(of[spaced], minlength=len(words)) == 0).tolist():
            words[at] = ""  # no unit with a space
        ids = self._ids_of(words)
        alone: dict[int, int] = {}
        for word, text in first_words.items():  # a first word has no space before it
            alone[word] = len(ids)
            ids.append(self._kept_alone(text) if text else b"")
        of[heads] = [alone[w] for w in of[heads].tolist()]
        found = pa.array(ids, pa.large_binary()).take(pa.array(of))
        ends, data = np.frombuffer(found.buffers()[1], "<i8")[found.offset:], found.buffers()[2]
        raw, cuts = memoryview(data) if data else b"", ends[offsets].tolist()
        return [bytes(raw[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        rows, begins, owner, size = [], [], [], 0

        def flush() -> None:
            for at, ids in zip(owner, self._rows(rows, begins), strict=True):
                out[at].append(ids)
            rows.clear(), begins.clear(), owner.clear()

        for at, text in enumerate(texts):
            if self.mark in text or _SPACE_RUN.search(text):
                out[at].append(self._odd(text))
                continue
            start = 0
            while start < len(text):  # a long text goes in parts, cut at spaces
                space = text.find(" ", start + LONGEST_ROW)
                end = len(text) if space < 0 else space
                rows.append(text[start:end])
                begins.append(start == 0)
                owner.append(at)
                size += end - start
                start = end + 1
                if size >= LONGEST_ROW:
                    flush()
                    size = 0
        if rows:
            flush()
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)
