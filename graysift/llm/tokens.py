"""Token ids of whole texts from a byte-level BPE file of the tokenizers library.

The file's pre-tokenizer always starts a piece at a space that stands between two characters which are not
white space, so a text falls into units " word" whose ids do not depend on each other. A piece of texts is cut and its
different units found by Arrow; marks after a word are a piece of their own, so a unit falls into a word and marks.
A worker keeps the ids of words it met lately; only new ones go to the library, many as one text. A file with other
rules is used text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def _even(text: str) -> bool:
    """Each space stands between two characters that are not white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(c in text and (" " + c in text or c + " " in text) for c in _SPACES)


def units(text: str) -> list[str]:
    """The text cut at each space that stands between two characters which are not white space, without that space. A
    byte-level pattern that takes a space with the word after it always starts a piece there."""
    return text.split(" ") if _even(text) else _CUT.split(text)


def _cuts_at_spaces(path: str) -> bool:
    """The file's rules are those that units rely on: no normalizer, bytes as letters with the usual pattern and no
    space put before a text, added tokens that hold no white space and take none, no dropout."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before, model = rules.get("pre_tokenizer") or {}, rules["model"]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in rules.get("added_tokens") or ())
    return bool(usual and added and not rules.get("normalizer") and not rules.get("truncation") and not rules.get("padding") and model["type"] == "BPE" and not model.get("dropout"))


#: Marks that stand after a word; with no letter after them they are one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ends of words that marks never join, and ends that may join a space that follows.
_CLOSED = "[A-Za-z0-9À-ÖØ-öø-ÿ]$"
_LOOSE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]$"
#: Words that a worker remembers, about 40 bytes each; bytes of texts that are cut together; new words in one text.
MEMORY, PIECE, LINE = 1_000_000, 1 << 23, 64
_STRING, _BYTES = pa.large_string(), pa.large_binary()


class Encoder:
    """encode(texts): for each text its ids, add_special_tokens=False, as little-endian unsigned 32-bit bytes.

    Null counts as empty. Beyond ``keep`` words, the half of them that was met last is kept.
    """

    def __init__(self, path: str, keep: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.keep, self.plain = Tokenizer.from_file(path), keep, not _cuts_at_spaces(path)
        self.added = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        vocabulary = self.library.get_vocab()
        #: Ids whose first byte is a space.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token[:1] == "Ġ"]] = True
        #: Words, their ids with a space before them, and the piece of texts that last had them.
        self.words, self.ids, self.met, self.pieces = pa.array([], _STRING), pa.array([], _BYTES), np.zeros(0, np.int64), 0

    def _ask(self, parts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _has_added(self, texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, self.added) if self.added else pa.repeat(False, len(texts))

    def _learn(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words in another order, and their ids. Those that hold no space and end with none are asked as one text: its
        pieces begin at the spaces between them."""
        alone = pc.or_(pc.or_(pc.match_substring(words, " "), pc.match_substring_regex(words, _LOOSE)), self._has_added(words))
        some, rest = words.filter(pc.invert(alone)), words.filter(alone)
        parts = some.to_pylist()
        raw = b"".join(self._ask([" " + " ".join(parts[k : k + LINE]) for k in range(0, len(parts), LINE)]))
        begins = np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])
        if len(begins) == len(parts):
            bounds = np.append(begins * 4, len(raw)).astype(np.int64)
            ids = pa.Array.from_buffers(_BYTES, len(parts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        else:
            ids = pa.array(self._ask([" " + w for w in parts]), _BYTES)
        return pa.concat_arrays([some, rest]), pa.concat_arrays([ids, pa.array(self._ask([" " + w for w in rest.to_pylist()]), _BYTES)])

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of words with a space before them."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = words.take(pa.array(unknown))
            fresh, ids = self._learn(missing.unique())
            at[unknown] = len(self.words) + pc.index_in(missing, value_set=fresh).to_numpy(zero_copy_only=False)
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, ids])
            self.met = np.append(self.met, np.zeros(len(fresh), np.int64))
        self.pieces += 1
        self.met[at] = self.pieces
        found = self.ids.take(pa.array(at))
        if len(self.words) > self.keep:
            kept = np.argsort(-self.met, kind="stable")[: self.keep // 2]
            self.words, self.ids, self.met = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept]
        return found

    def _unit_ids(self, units: pa.Array) -> pa.Array:
        """The ids of different units with a space before them."""
        words = pc.utf8_rtrim(units, MARKS)
        cut = pc.and_not(pc.match_substring_regex(words, _CLOSED), self._has_added(units))
        words = pc.if_else(cut, words, units)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(pc.utf8_length(units).to_numpy(zero_copy_only=False) > sizes)
        marks = pa.array([u[n:] for u, n in zip(units.take(pa.array(marked)).to_pylist(), sizes[marked].tolist(), strict=True)], _STRING).dictionary_encode()
        which = np.zeros(len(units), np.int64)
        which[marked] = marks.indices.to_numpy(zero_copy_only=False) + 1
        tails = pa.array([b"", *self._ask(marks.dictionary.to_pylist())], _BYTES)
        return pc.binary_join_element_wise(self._ids_of(words), tails.take(pa.array(which)), pa.scalar(b"", _BYTES))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.plain:
            return self._ask([t or "" for t in texts])
        out, even, other = [b""] * len(texts), [], []
        for k, text in enumerate(texts):
            if text:
                (even if _even(text) else other).append(k)
        if not even and not other:
            return out
        split = pc.split_pattern(pa.array([texts[k] for k in even], _STRING), " ")
        split = pa.concat_arrays([split, pa.array([_CUT.split(texts[k]) for k in other], split.type)])
        units, bounds = split.flatten(), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64))
        # a text's first unit has no space before it
        first = np.zeros(len(units), bool)
        first[bounds[:-1]] = True
        later, heads = units.filter(pa.array(~first)).dictionary_encode(), units.filter(pa.array(first)).dictionary_encode()
        which = np.empty(len(units), np.int64)
        which[~first] = later.indices.to_numpy(zero_copy_only=False)
        which[first] = heads.indices.to_numpy(zero_copy_only=False) + len(later.dictionary)
        known = pa.concat_arrays([self._unit_ids(later.dictionary), pa.array(self._ask(heads.dictionary.to_pylist()), _BYTES)])
        found = known.take(pa.array(which))
        ends, raw = np.frombuffer(found.buffers()[1], np.int64)[bounds].tolist(), memoryview(found.buffers()[2] or b"")
        for k, begin, end in zip([*even, *other], ends, ends[1:], strict=False):
            out[k] = bytes(raw[begin:end])
        return out


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about PIECE bytes, to be encoded one by one."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < batch.num_rows:
        most = PIECE + (int(ends[begin - 1]) if begin else 0)
        end = max(begin + 1, int(np.searchsorted(ends, most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


@lru_cache(maxsize=1)
def encoder(path: str, keep: int = MEMORY) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, keep)
