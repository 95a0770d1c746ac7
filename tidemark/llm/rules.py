"""Operator 8: quality rules on counts of words, symbols and repeats, and on tokeniser fertility per script."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, kept_by_worker, on_workers, segments, words

SYMBOLS = "#*$%&|<>"
MARK = "\u2581"
#: Words of characters that no normalisation changes or joins, all letters among them Latin.
_LATIN = re.compile("[!-~¡-¨«-³¶-¸»À-ÖØ-öø-ÿ]+")
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
VOCABULARY = "piece_bpe_32k.model"
#: Above this many words, repeated windows are found by numbers of words in arrays instead of by tuples of words, with the same result.
LONG = 200_000


class Band(NamedTuple):
    """What a text of a script may measure: characters per token, share of byte-fallback tokens, and bits of token entropy.

    The entropy's lower bound is the smaller of bits and share_of_log times log2 of the token count, so short texts aren't judged by it.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    bits: float = 3.5
    share_of_log: float = 0.5


#: Bands for a 32k vocabulary trained mostly on European languages, wide around ordinary prose. LATIN's entropy
#: was chosen on half of the labels at sf0.1, as what rejects most junk of all bounds that lose no clean document there.
BANDS = {
    "LATIN": Band(1.2, 8.0, 0.10, 6.35, 0.67),
    "CYRILLIC": Band(1.0, 6.0, 0.10),
    "GREEK": Band(0.7, 4.0, 0.30),
    "ARABIC": Band(0.6, 4.0, 0.50),
    "HEBREW": Band(0.6, 4.0, 0.50),
    "CJK": Band(0.25, 4.0, 0.98),
    "HIRAGANA": Band(0.3, 4.0, 0.90),
    "KATAKANA": Band(0.3, 4.0, 0.90),
    "HANGUL": Band(0.25, 4.0, 0.98),
}
#: Scripts that the vocabulary hardly has: fertility says little, only degenerate texts go.
OTHER = Band(0.2, 8.0, 1.0)
SCRIPTS = ["", *BANDS, "OTHER"]


def script_of(word: str) -> int:
    """The place in SCRIPTS of the script that most of a word's letters have; 0 without a letter."""
    if _LATIN.fullmatch(word):
        return int(_LETTER.search(word) is not None)
    names = Counter(unicodedata.name(c, "OTHER").split(" ")[0] for c in word if c.isalpha())
    if not names:
        return 0
    name = min(names, key=lambda n: (-names[n], n))
    return SCRIPTS.index(name) if name in BANDS else len(SCRIPTS) - 1


class _Scripts(dict):
    def __missing__(self, word: str) -> bytes:
        self[word] = b"%c" % script_of(word)
        return self[word]


class Fertility:
    """Token counts of texts, word by word; a word's ids are remembered, up to a number of words.

    New words are encoded many at once: a word's first piece is the one that begins with the mark of a blank.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remember: int = 200_000):
        import public_tokenizers
        import sentencepiece

        path = public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.byte_ids = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.begins = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.size)])
        self.remember, self.ids, self.scripts = remember, {}, _Scripts()

    def measure(self, words: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts by token id and by script of a text's words."""
        known = self.ids
        if new := set(words).difference(known):
            if len(known) + len(new) > self.remember:
                known = self.ids = {}
                self.scripts.clear()
                new = set(words)
            self._learn(new)
        tokens = np.bincount(np.frombuffer(b"".join([known[w] for w in words]), "<u2"), minlength=self.size)
        if text.isascii():
            return tokens, np.bincount([int(_LETTER.search(text) is not None)], minlength=len(SCRIPTS))
        scripts = self.scripts
        return tokens, np.bincount(np.frombuffer(b"".join([scripts[w] for w in words]), np.uint8), minlength=len(SCRIPTS))

    def _learn(self, new: set[str]) -> None:
        plain = [w for w in new if _LATIN.fullmatch(w)]
        if plain:
            ids = np.array(self.model.encode(" ".join(plain), num_threads=1), "<u2")
            cuts = [*(np.flatnonzero(self.begins[ids]) * 2).tolist(), 2 * len(ids)]
            flat = ids.tobytes()
            self.ids.update(zip(plain, map(flat.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        if other := [*new.difference(plain)]:
            for w, ids in zip(other, self.model.encode(other, num_threads=1), strict=True):
                self.ids[w] = np.array(ids, "<u2").tobytes()


def covered_by_repeats(words: list[str], n: int = 5) -> int:
    """Words inside n-word windows that stand twice or more in the text."""
    if len(words) <= n:
        return 0
    if len(words) > LONG:
        numbers: dict[str, int] = {}
        of = each = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        for i in range(1, n):  # windows of i + 1 words as numbers, from those of i words and the word after
            of = np.unique(of[: len(words) - i] * len(numbers) + each[i:], return_inverse=True)[1]
        twice = np.bincount(of)[of] > 1
    else:
        windows = list(zip(*(words[i:] for i in range(n)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count = Counter(windows)
        twice = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words) + 1, int)
    cover[: len(twice)] += twice
    cover[n : n + len(twice)] -= twice
    return int((cover.cumsum() > 0).sum())


def base_counts(text: str, of: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(of),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        covered_by_repeats(of),
    )


def within(n_chars: int, tokens: np.ndarray, byte_ids: np.ndarray, scripts: np.ndarray, bands: dict[str, Band] = BANDS) -> tuple:
    """n_tokens, chars_per_token, byte_share, token_entropy, script, and whether all are in the script's band."""
    n = int(tokens.sum())
    if not n:
        return 0, 0.0, 0.0, 0.0, "", False
    script = SCRIPTS[int(scripts[1:].argmax()) + 1] if scripts[1:].any() else ""
    p = tokens[tokens > 0] / n
    chars, share, bits = n_chars / n, float(tokens[byte_ids].sum() / n), float(-(p * np.log2(p)).sum()) + 0.0
    band = bands.get(script, OTHER)
    fits = band.least_chars <= chars <= band.most_chars and share <= band.most_bytes and bits >= min(band.bits, band.share_of_log * math.log2(n))
    return n, chars, share, bits, script, bool(fits and script)


COLUMNS = [
    *((n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("n_tokens", pa.int64()),
    *((n, pa.float64()) for n in ("chars_per_token", "byte_share", "token_entropy")),
    ("script", pa.string()),
]
SCHEMA = ", ".join(f"{n} {({pa.int64(): 'long', pa.bool_(): 'boolean', pa.float64(): 'double', pa.string(): 'string'})[t]}" for n, t in COLUMNS)

def judged(texts: Iterable[str | None], fertility: Fertility) -> Iterator[tuple]:
    """A row of COLUMNS but doc_id for each text."""
    for text in texts:
        text = text or ""
        of, tokens, scripts = [], 0, 0
        for part in segments(text):
            more = words(part)
            of += more
            a, b = fertility.measure(more, part)
            tokens, scripts = tokens + a, scripts + b
        base = base_counts(text, of)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        *measured, fits = within(base[1], tokens, fertility.byte_ids, scripts)
        yield *base, failed, fits and not failed, *measured


def quality(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs: base counts, fertility measures and the verdict.

    Reads doc_id and text, ignores other columns. Tokens are those of the text with a space for each run of blanks, as
    the vocabulary spells line ends as bytes. Null counts as the empty text, which has no word and fails; a text without a letter has no script and isn't kept. Repeated rows are judged each, a null
    doc_id stays null. One pass without a shuffle.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, fertility = pa.schema(COLUMNS), kept_by_worker(("fertility", vocabulary), lambda: Fertility(vocabulary))
        for batch in batches:
            rows = [(d, *r) for d, r in zip(batch.column("doc_id").to_pylist(), judged(batch.column("text").to_pylist(), fertility), strict=True)]
            cols = zip(*rows) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, COLUMNS, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def filtered(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: the verdict is taken beside each row, so ids needn't be unique."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = kept_by_worker(("fertility", vocabulary), lambda: Fertility(vocabulary))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([bool(r[6]) for r in judged(batch.column(at).to_pylist(), fertility)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
