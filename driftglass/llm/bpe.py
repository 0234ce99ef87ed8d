"""BPE by backtracking over longest matches; decoding by an offset table.

Encoding. A token that a merge can make and that encodes to itself is *whole*. The merges turn a pre-token into the one
sequence of whole tokens in which each neighbouring pair is compatible, that is, in which the merges of the two
tokens side by side never cross the border between them. So the sequence is found without merging: an Aho-Corasick
automaton gives the longest token from each place; it is taken if the pair table says that it suits the token before
it, else the next shorter token that starts it is tried, and where none is left the last token is taken back. The
tokens before a place are the same whatever comes after, so a place that was left once is never tried again and the
work is linear in the text's length, pre-tokens of any length included.

The pair table is filled as pairs are met. The tokens at a border grow by merges on both sides, in the order of the
merges' ranks; a pair is incompatible if at some time the two that meet have a merge that comes before the next change
of either side (of equal ranks the left one is first).

Decoding. The table holds the pieces of all ids in one buffer with their offsets (Arrow's layout); a column of ids is
gathered from it, and pieces are joined as the file's decoder says: bytes in a row, or pieces with a space between them
where it names no decoder. Bytes that are no UTF-8 become U+FFFD. Ids outside the vocabulary have no piece.

Texts are cut into pre-tokens as the file says; special tokens are found before that. Each distinct pre-token is
encoded once in a worker.

Edge cases: a null text is empty and has no ids; an empty list of ids decodes to an empty text; rows with null or
repeated ids are kept, each on its own; an empty table gives no rows; other columns of the input are ignored. Rows stay
in their partitions: nothing is shuffled and memory holds a slice of some megabytes, or one text if that is longer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trim
from .word_memo import WordMemo, _byte_letters, _Generations

#: Added to the last letter of a word where the vocabulary marks ends of words.
_FINAL = 0x1000
_NEVER = 1 << 62
#: Pairs remembered in a worker; then the table starts anew.
PAIRS = 1_000_000


class Backtracker:
    """Exact BPE of pre-tokens, given in the letters that stand for bytes."""

    def __init__(self, spec: dict):
        import ahocorasick

        model = spec["model"]
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level merges are supported")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        keys: dict[int, str] = {}
        for letter in _byte_letters().values():
            keys[vocab[letter]] = letter
            if self.suffix:
                keys[vocab[letter + self.suffix]] = chr(ord(letter) + _FINAL)
        self.rank: dict[tuple[int, int], int] = {}
        born = dict.fromkeys(keys, -1)
        # the tokens at a token's two edges, from its letter on, each with the rank of the merge that makes it
        first, last = {t: [(t, -1)] for t in keys}, {t: [(t, -1)] for t in keys}
        self.first, self.last = first, last
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            names = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocab[names[0]], vocab[names[1]], vocab["".join(names)]
            if made in born or a not in born or b not in born:
                raise ValueError("each token must be made by one merge, from tokens made before")
            self.rank[a, b], born[made], parts[made] = rank, rank, (a, b)
            keys[made] = keys[a] + keys[b]
            first[made], last[made] = [*first[a], (made, rank)], [*last[b], (made, rank)]
        whole: set[int] = set()
        for token in keys:  # parts come before what is made of them
            pair = parts.get(token)
            if pair is None or (pair[0] in whole and pair[1] in whole and self._crossed(*pair) == born[token]):
                whole.add(token)
        self.size = {t: len(keys[t]) for t in whole}
        by_key = {keys[t]: t for t in whole}
        self.shorter = {t: next((by_key[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in by_key), -1) for k, t in by_key.items()}
        self.matches = ahocorasick.Automaton()
        for key, token in by_key.items():
            self.matches.add_word(key, (len(key), token))
        self.matches.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _crossed(self, left: int, right: int) -> int | None:
        """The rank of the first merge over the border of two tokens side by side; None: there is none."""
        ours, theirs, i, j = self.last[left], self.first[right], 0, 0
        while True:
            rank = self.rank.get((ours[i][0], theirs[j][0]), _NEVER)
            next_left = ours[i + 1][1] if i + 1 < len(ours) else _NEVER
            next_right = theirs[j + 1][1] if j + 1 < len(theirs) else _NEVER
            if rank < next_left and rank <= next_right and rank < _NEVER:
                return rank
            if next_left == next_right == _NEVER:
                return None
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._crossed(left, right) is None
        return known

    def encode(self, letters: str) -> list[int]:
        """The ids of one pre-token."""
        if self.suffix and letters:
            letters = letters[:-1] + chr(ord(letters[-1]) + _FINAL)
        n, size, shorter = len(letters), self.size, self.shorter
        longest = [-1] * (n + 1)
        for stop, (length, token) in self.matches.iter(letters):
            longest[stop - length + 1] = token  # a later match from the same place is longer
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (at + size[token] in dead or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out


class BacktrackingMemo(WordMemo):
    """Ids of texts, pre-tokens encoded by backtracking; the library only normalises and cuts."""

    def __init__(self, path: str, spaced: bool):
        super().__init__(path, spaced)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        for token in spec["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("special tokens must be plain strings")
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.marks, key=len, reverse=True)) + ")")
        self.merger = Backtracker(spec)
        self.by_letters = _Generations(self._merge)

    def _merge(self, letters: str) -> bytes:
        return np.array(self.merger.encode(letters), "<u4").tobytes()

    def _pre_token(self, piece: str) -> bytes:
        return self._merge(piece.encode().decode("latin-1").translate(self.letters))

    def _library(self, text: str) -> bytes:
        """Texts and words that need the library's own normalisation and cuts."""
        self.by_letters.trim()
        found = []
        for part in self.at_marks.split(text) if self.marks else [text]:
            if part in self.marks:
                found.append(self.marks[part].to_bytes(4, "little"))
            elif part:
                part = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                found += [self.by_letters[letters] for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return b"".join(found)


class Decoder:
    """Texts of ids from the offset table of their pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pieces = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        decoder, letters = spec.get("decoder"), {v: k for k, v in _byte_letters().items()}
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("the decoder must be ByteLevel or absent")

        def of(piece: str) -> bytes:
            if decoder and all(c in letters for c in piece):
                return bytes(letters[c] for c in piece)
            return piece.encode()

        self.separator = b"" if decoder else b" "
        self.table = pa.array([of(pieces[i]) if i in pieces else None for i in range(max(pieces) + 1)], pa.binary())

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that lie in a row and end at ``ends``."""
        starts = np.concatenate((np.zeros(1, np.int64), ends))
        known = ids < len(self.table)
        if not known.all() or self.table.null_count:
            known[known] = self.table.is_valid().to_numpy(zero_copy_only=False)[ids[known]]
            starts, ids = np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))[starts], ids[known]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.table.take(pa.array(ids)))
        joined = pc.binary_join(lists, self.separator)
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


_MEMOS: dict[tuple[str, bool], BacktrackingMemo] = {}
_DECODERS: dict[str, Decoder] = {}


def _memo(path: str, spaced: bool) -> BacktrackingMemo:
    if (path, spaced) not in _MEMOS:
        _MEMOS[path, spaced] = BacktrackingMemo(path, spaced)
    return _MEMOS[path, spaced]


def _decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate((np.zeros(1, np.int64), 4 * ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def encode(docs: DataFrame, tokenizer: str, spaced: bool, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id`` and ``ids`` (little-endian unsigned 32-bit) of each text; ``decoded`` adds ``text``, decoded from these ids.

    ``tokenizer`` is the path of a tokenizers file; ``spaced``: its words carry the space before them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        memo = _memo(tokenizer, spaced)
        for batch in batches:
            at = 0
            for ids, ends in memo.encode(batch.column(1)):
                columns = [batch.column(0).slice(at, len(ends)), _binary(ids, ends)]
                at += len(ends)
                columns += [_decoder(tokenizer).decode(ids, ends)] if decoded else []
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"][: len(columns)])

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(rows, "id long, ids binary" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` of each row's ids; null ids are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(tokenizer)
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), decoder.decode(np.concatenate([*lists, np.zeros(0, "<u4")]), ends)], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(rows, "id long, text string")
