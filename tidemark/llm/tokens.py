"""Token ids of whole texts under the public word-end BPE, by a bounded memory of blank-free chunks."""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from tidemark.llm.shared import kept_by_worker, segments, spaced

VOCABULARY = "word_bpe_49k.json"
#: Letters that stay one letter each in lower case and in any normal form.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class ChunkEncoder:
    """Encodes whole texts exactly as the tokenizer does.

    This vocabulary drops white space, lowers case and never merges across white space or from a letter to
    another character, so a text's ids are those of its blank-free chunks in a row, and a chunk's are those
    of the letters it begins with and of the rest. Chunks and parts are remembered, up to a number of each.
    Plain words are encoded many at once: each ends with an id that ends a word.
    Special tokens' strings in a text are those tokens, as by the tokenizer's default, or ordinary text if special is
    false. They are found in a text as it is, so a text with one in any case isn't lower-cased beforehand.
    """

    def __init__(self, vocabulary: str = VOCABULARY, dtype: str = "<u4", special: bool = True, chunks: int = 200_000, parts: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        self.tokenizer.encode_special_tokens = not special
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.marked = re.compile("|".join(map(re.escape, marks)), re.I).search if marks else lambda text: None
        ends = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ends.values()) + 1, bool)
        self.ends[[i for w, i in ends.items() if w.endswith("</w>")]] = True
        self.dtype, self.most_chunks, self.most_parts = np.dtype(dtype), chunks, parts
        self.chunks, self.parts = {"": b""}, {"": b""}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as bytes of the dtype."""
        for text in texts:
            yield b"".join(map(self._segment, segments(text)))

    def _segment(self, text: str) -> bytes:
        if not self.marked(text):
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                text = text.lower()  # of these letters, one letter each: fewer chunks differ
        chunks, known = spaced(text).split(" "), self.chunks
        if new := set(chunks).difference(known):
            if len(known) + len(new) > self.most_chunks:
                known = self.chunks = {"": b""}
                new = set(chunks)
            self._learn(new)
        return b"".join([known[c] for c in chunks])

    def _learn(self, new: set[str]) -> None:
        split = []
        for c in new:
            m = _LETTERS.match(c)
            cut = m.end() if m else 0
            if cut < len(c) and c[cut] > "\x7f":  # a letter of another script or a mark that joins the last letter
                split.append((c, "", c))
            else:
                split.append((c, c[:cut].lower(), c[cut:]))
        parts = self.parts
        if len(parts) + 2 * len(split) > self.most_parts:
            parts = self.parts = {"": b""}
        if plain := [*{w for _, w, _ in split if w not in parts}]:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()]
            flat = ids.astype(self.dtype).tobytes()
            parts.update(zip(plain, map(flat.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        if other := [*{r for _, _, r in split if r not in parts}]:
            for r, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                parts[r] = np.array(e.ids, self.dtype).tobytes()
        for c, w, r in split:
            self.chunks[c] = parts[w] + parts[r] if r else parts[w]


def encoder(vocabulary: str = VOCABULARY, dtype: str = "<u4", special: bool = True) -> ChunkEncoder:
    """One encoder a worker process."""
    return kept_by_worker(("encoder", vocabulary, dtype, special), lambda: ChunkEncoder(vocabulary, dtype, special))
