"""Token ids of whole texts with a public tokenizer, at the speed of looking words up."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict[str, "Encoder"] = {}


# A chunk of such characters has the words that WORDS finds, as the tokenizer's own pattern does; all others go to
# the tokenizer as they are. Letters and digits of Latin-1 are fixed values. Chunks are looked at many at once, a line end between them.
PLAIN = re.compile("[!-~\xa1-\xff]*")
PLAIN_LINES = re.compile("[\n!-~\xa1-\xff]*")
WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\n0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")


def _lines(values: pa.Array) -> str:
    """Strings in one, a line end between them: a call for all, where ``to_pylist`` takes a microsecond and more for each."""
    whole = values.cast(pa.large_string())
    one = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
    return pc.binary_join(one, pa.scalar("\n", pa.large_string()))[0].as_py()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, the same as ``Tokenizer.encode`` gives.

    For a tokenizer with word ends that lowers letters: it never joins what stands on two sides of a blank, nor
    letters with other signs, so each different chunk of a slice of texts is split once and each different word encoded once
    per worker. Past ``LIMIT`` words only what the last slice of texts had is remembered.
    """

    LIMIT, SLICE = 1_000_000, 4_000_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Word numbers, and the ids of word ``n`` at ``ids[bounds[n]:bounds[n + 1]]``."""
        self.numbers: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn(self, words: list[str]) -> None:
        """Encode words in one go: each ends with an id that ends a word."""
        found = self._encode([" ".join(words[i:i + 500]) for i in range(0, len(words), 500)])
        ids = np.concatenate(found)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            found = self._encode(words)
            ids, stops = np.concatenate(found), np.cumsum([len(f) for f in found])
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))
        self.bounds = np.concatenate([self.bounds, stops + self.bounds[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def _find(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, a line each, one after the other, and where each begins; the last entry is the end."""
        other: dict[int, np.ndarray] = {}
        if not PLAIN_LINES.fullmatch(lines) or "<|" in lines:
            chunks = lines.split("\n")
            odd = [i for i, c in enumerate(chunks) if "<|" in c or not PLAIN.fullmatch(c)]
            other = dict(zip(odd, self._encode([chunks[i] for i in odd])))
            lines = "\n".join("" if i in other else c for i, c in enumerate(chunks))
        coded = pa.array(["\n", *WORDS.findall(lines.lower())], pa.large_string()).dictionary_encode()
        # The first of the different parts is the line end, which begins every chunk.
        words = _lines(coded.dictionary[1:]).split("\n") if len(coded.dictionary) > 1 else []
        if len(self.numbers) > self.LIMIT:
            self._forget()
        new = [w for w in words if w not in self.numbers]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        part = coded.indices.to_numpy()
        begins = np.flatnonzero(part == 0)
        first = np.concatenate([[0], self.bounds[number]])[part]
        length = np.concatenate([[0], (self.bounds[1:] - self.bounds[:-1])[number]])[part]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(first - (ends - length), length) + np.arange(ends[-1])]
        starts = np.concatenate([(ends - length)[begins], ends[-1:]])
        if other:
            pieces, last = [], 0
            sizes = np.diff(starts)
            for i, own in other.items():
                pieces += [ids[last:starts[i]], own]
                last = starts[i]
                sizes[i] = len(own)
            ids = np.concatenate([*pieces, ids[last:]])
            starts = np.concatenate([[0], np.cumsum(sizes)])
        return ids, starts

    def _texts(self, texts: pa.Array) -> Iterator[bytes]:
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        found, starts = self._find(_lines(coded.dictionary))
        at = coded.indices.to_numpy()
        counts = np.diff(starts)[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # Half the memory to go through where the numbers are small.
        kind = np.int32 if max(ends[-1], len(found)) < 1 << 31 else np.int64
        where = np.repeat((starts[at] - ends[:-1]).astype(kind), counts)
        where += np.arange(ends[-1], dtype=kind)
        ids = found[where]
        offsets = chunks.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b].tobytes()

    def stream(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, a slice of texts at a time. Null is an empty text."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at, collects = 0, gc.isenabled()
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.SLICE)))
            gc.disable()  # many small objects, no cycles
            found = list(self._texts(texts.slice(at, stop - at)))
            if collects:
                gc.enable()
            yield from found
            at = stop


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
