"""Text to token ids with the tokenizers library, at the speed of a dictionary.

The pre-tokenizer's pattern of a byte-level BPE always starts a new piece at a
space that is followed by something else than white space, whatever stands in
front of it.  So a text may be cut at such spaces, each part encoded on its own
by the library, and the ids joined: the result is that of the whole text.
Parts repeat, so each worker remembers the ids of the parts it has met.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

_UNSAFE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
END = struct.pack("<I", 0)
_OPEN: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def opened(path: str) -> "Encoder":
    """One encoder per worker process and tokenizer file."""
    common.release_memory()
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    """encode() gives the ids of a text as little-endian unsigned 32-bit integers.

    The parts met so far are kept as columns (strings, offsets, ids), so that a
    batch is looked up and put together without a Python object per part.
    ``most_bytes`` bounds these columns; beyond it they are emptied, which
    changes the time and nothing else.
    """

    def __init__(self, path: str, most_bytes: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._most = most_bytes
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, at in vocabulary.items():
            self._bytes[at] = len(token)  # the vocabulary writes each byte as one character
        self._forget()

    def _forget(self) -> None:
        self._parts = pa.array([], pa.string())  # with a space before each
        self._data = np.zeros(0, "<u4")
        self._ends = np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in found]

    def _learn(self, new: pa.Array) -> None:
        """Append parts that aren't kept yet, in this order.  Many are encoded as one
        string, and each gets the ids that make up its bytes."""
        ids, ends, before = [self._data], [self._ends], len(self._data)
        for at in range(0, len(new), 1000):
            some = new.slice(at, 1000)
            text = " " + " ".join(some.to_pylist())
            found = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            bytes_to = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            cuts = np.searchsorted(np.cumsum(self._bytes[found]), bytes_to, "left") + 1
            ids.append(found)
            ends.append(cuts + before)
            before += len(found)
        self._data, self._ends = np.concatenate(ids), np.concatenate(ends)
        self._parts = pa.concat_arrays([self._parts, new])

    def _rows_of(self, parts: pa.Array) -> np.ndarray:
        """The row of each part in the columns; parts that are new are learnt."""
        if self._parts.nbytes + self._data.nbytes + self._ends.nbytes > self._most:
            self._forget()
        at = pc.index_in(parts, value_set=self._parts)
        rows = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            coded = pc.dictionary_encode(parts.filter(at.is_null()))
            rows[rows < 0] = len(self._parts) + coded.indices.to_numpy()
            self._learn(coded.dictionary)
        return rows

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        rows = [i for i, text in enumerate(texts) if text]
        plain = [i for i in rows if not _UNSAFE.search(texts[i])]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        first = lists.offsets.to_numpy().tolist()
        spans = dict(zip(plain, zip(first, first[1:])))
        more: list[str] = []
        at = first[-1]
        for i in rows:
            if i not in spans:
                parts = _CUT.split(texts[i])
                more += parts
                spans[i] = (at, at + len(parts))
                at += len(parts)
        which = self._rows_of(pa.concat_arrays([lists.flatten(), pa.array(more, pa.string())]))
        sizes = np.diff(self._ends, prepend=0)
        each = sizes[which]
        ends = np.cumsum(each)
        place = np.repeat((self._ends[which] - ends).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        joined, ends = self._data[place], ends.tolist()
        # The first part of a text has no space before it.
        heads = dict(zip(rows, self._library([_CUT.split(texts[i], maxsplit=1)[0] for i in rows])))
        return [heads[i] + joined[ends[spans[i][0]] : ends[spans[i][1] - 1]].tobytes() if i in spans else b"" for i in range(len(texts))]


def slices(keys: pa.Array, texts: pa.Array, size: int = 4 << 20):
    """(keys, texts) as lists, with about size bytes of text each, so that a batch of long texts stays small."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield keys.slice(start, stop - start).to_pylist(), texts.slice(start, stop - start).to_pylist()
        start = stop
