"""Token ids by the tokenizers library, a column of texts at once.

Both public vocabularies used here cut a text before white space that follows a word, whatever stands around it, so the
ids of a text are those of its words in a row. A slice of texts is split at spaces by Arrow and its words are
dictionary-encoded, so each distinct word of a slice is looked at once; the ids of the texts are then gathered from
those of the words. A word of Latin letters with punctuation after it is cut by a pattern; pre-tokens are remembered in
the worker, and the library's model encodes those not yet seen. Other words are cut one by one, and words with
characters beyond Latin letters, where normalisation needs more care, are encoded by the library as a whole. So are
texts that hold a special token of the vocabulary, which the library finds before it cuts anything.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import trim

_WORD_STARTS = re.compile(r"(?<=\S)(?= )")
#: White space before a space: there the space does not follow a word. These are all characters that ``\s`` matches.
_ODD = "[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "] "
#: Latin letters (those that are one letter in lower case), then punctuation, and once more after a line break.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+", "[.,;:!?]*"
_SIMPLE = f"^(?P<stem>{_LETTERS})(?P<tail>{_MARKS})(?:(?P<line>\n)(?P<more>{_LETTERS})(?P<rest>{_MARKS}))?$"
#: Words and pre-tokens are remembered up to this many; then the older generation is let go.
MOST = 150_000
#: Bytes of text that are encoded together.
SLICE = 1 << 21


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others for
    the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Generations(dict):
    """A dict that computes what it lacks, and keeps what was in use when it last grew too large."""

    def __init__(self, compute: Callable[[str], bytes], most: int | None = None):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.compute(word)
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > (self.most or MOST):
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class _Table:
    """Sequences of ids, by number."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    @classmethod
    def of(cls, parts: list[bytes]) -> _Table:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these sequences in a row, where each one ends)."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.start[numbers] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], ends


def _joined(tables: list[_Table]) -> _Table:
    return _Table(np.concatenate([t.ids for t in tables]), np.concatenate([t.size for t in tables]))


class WordMemo:
    """``spaced``: a word's ids depend on the space before it (byte-level vocabularies); else white space is dropped
    and letters are lower-cased. ``most``: words remembered, by default ``MOST``."""

    def __init__(self, path: str, spaced: bool, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.model, self.letters = spaced, self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        self.cut = regex.compile(split[0] if split else public_tokenizers.PATTERN).findall
        self.pre_tokens = _Generations(self._pre_token, most)
        self.after_space = _Generations(lambda piece: self._pre_token(" " + piece), most)
        self.words = _Generations(self._word, most)
        self.memos = (self.pre_tokens, self.after_space, self.words)

    def forget(self) -> None:
        """Let all words go, so that an idle worker holds the vocabulary only."""
        for memo in self.memos:
            memo.forget()
        trim()

    def _pre_token(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii() and (max(word) >= "ɐ" or not unicodedata.is_normalized("NFC", word)):
            return self._library(word)
        return b"".join(map(self.pre_tokens.__getitem__, self.cut(word if self.spaced else word.lower())))

    def _alone(self, text: str) -> bytes:
        """The ids of a text that spaces alone cannot cut."""
        if any(s in text for s in self.special):
            return self._library(text)
        return b"".join(map(self.words.__getitem__, _WORD_STARTS.split(text)))

    def _distinct(self, words: pa.Array, spaced: bool) -> _Table:
        """The ids of each word; ``spaced``: a space is before it."""
        found = pc.extract_regex(words, _SIMPLE)
        valid = found.is_valid()
        simple = valid.to_numpy(zero_copy_only=False)
        parts, numbers, known = [b""], [], 1
        for name in ("stem", "tail", "line", "more", "rest"):
            if name == "line" and not self.spaced:
                continue
            part = found.field(name).filter(valid)
            part = (part if self.spaced else pc.utf8_lower(part)).dictionary_encode()
            names = part.dictionary.to_numpy(zero_copy_only=False).tolist()
            memo = self.after_space if spaced and name == "stem" else self.pre_tokens
            parts += map(memo.__getitem__, names)
            numbers.append(part.indices.to_numpy().astype(np.int64) + known)
            known += len(names)
        ids, ends = _Table.of(parts).rows(np.stack(numbers, 1).ravel())
        stops = ends[len(numbers) - 1 :: len(numbers)]
        space = " " if spaced else ""
        others = words.filter(pc.invert(valid)).to_numpy(zero_copy_only=False).tolist()
        rest = _Table.of([self.words[space + x] if space + x else b"" for x in others])
        table, number = _joined([_Table(ids, np.diff(stops, prepend=0)), rest]), np.empty(len(words), np.int64)
        number[np.flatnonzero(simple)], number[np.flatnonzero(~simple)] = np.arange(len(stops)), len(stops) + np.arange(len(others))
        return _Table(table.rows(number)[0], table.size[number])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the texts in order: (their ids in a row, unsigned 32-bit; where each text ends). Null is empty; an
        end id, if given, follows each text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        before, at = np.cumsum(sizes) - sizes, 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + SLICE)))
            yield self._slice(pc.fill_null(texts.slice(at, stop - at).cast(pa.large_string()), ""), end_id)
            at = stop

    def _slice(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        for memo in self.memos:
            memo.trim()
        alone = np.zeros(len(texts), bool)
        for mark in self.special:
            alone |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if self.spaced:
            alone |= pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        whole = [self._alone(x) for x in texts.filter(pa.array(alone)).to_pylist()]
        lists = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        flat = lists.flatten().dictionary_encode()
        code, ends = flat.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        first = ends[:-1]
        tables = [self._distinct(flat.dictionary, self.spaced)]
        known = len(flat.dictionary)
        if self.spaced:  # a text's first word has no space before it
            names, place = np.unique(code[first], return_inverse=True)
            code[first] = known + place
            tables.append(self._distinct(flat.dictionary.take(pa.array(names)), False))
            known += len(names)
        code[first[alone]] = known + np.arange(len(whole))
        tables.append(_Table.of([*whole, (end_id or 0).to_bytes(4, "little")]))
        if end_id is not None:
            code = np.insert(code, ends[1:], known + len(whole))
            ends = ends + np.arange(len(ends))
        ids, stops = _joined(tables).rows(code)
        trim()
        return ids, np.concatenate((np.zeros(1, np.int64), stops))[ends[1:]]


_MEMO: dict[tuple[str, bool, int | None], WordMemo] = {}


def memo_for(path: str, spaced: bool, most: int | None = None) -> WordMemo:
    """One for each vocabulary, size and Python worker; it outlives a task."""
    if (path, spaced, most) not in _MEMO:
        _MEMO[path, spaced, most] = WordMemo(path, spaced, most)
    return _MEMO[path, spaced, most]
