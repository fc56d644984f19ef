"""Per-document statistics of whole texts, vectorised; shared by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import IS_CONT, IS_DIGIT, IS_LOWER, IS_SPACE, IS_UPPER, Slice, mix64, ngram_hashes, span_hashes

# code points counted as symbols: # * $ % & | < >
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_ALNUM = IS_UPPER | IS_LOWER | IS_DIGIT | (np.arange(256) >= 128)
_PUNCT = ~(_ALNUM | IS_SPACE)
_NEWLINE = np.arange(256) == 10

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_lower", "n_digits", "n_punct",
    "n_lines", "n_distinct", "n_adjacent", "n_end_punct", "n_symbol_words", "n_upper_words", "n_punct_words", "n_long_words", "n_exclaim", "n_pipe",
]

RATES = [
    "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "words_per_line", "distinct_rate",
    "adjacent_rate", "end_punct_rate", "symbol_word_rate", "upper_word_rate", "punct_word_rate", "long_word_rate", "log_words", "exclaim_rate", "pipe_rate",
]


def _distinct_flags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For values h of documents doc: (order, first of its run in that order, run length in that order)."""
    key = h ^ mix64(doc.astype(np.uint64) + np.uint64(7))
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    run = np.repeat(np.diff(np.append(starts, len(k))), np.diff(np.append(starts, len(k))))
    return order, new, run


def count_statistics(s: Slice) -> np.ndarray:
    """(documents, len(COUNTS)) of a slice."""
    n, buf = len(s), s.buf
    counts = s.counts()
    out = dict.fromkeys(COUNTS, np.zeros(n, np.int64))
    out["n_words"] = counts
    if not len(buf):
        return np.stack([out[c] for c in COUNTS], 1)
    lead = ~IS_CONT[buf]
    cum = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    of_byte = lambda table: s.per_doc(table[buf])
    word_doc = s.doc_of_word()
    per_doc = lambda mask: np.bincount(word_doc[mask], minlength=n)
    lengths = cum[s.end] - cum[s.start]
    out["word_chars"] = np.bincount(word_doc, lengths, n).astype(np.int64)
    out["n_symbols"], out["n_chars"], out["n_upper"], out["n_lower"] = of_byte(_SYMBOL), s.per_doc(lead), of_byte(IS_UPPER), of_byte(IS_LOWER)
    out["n_digits"], out["n_punct"] = of_byte(IS_DIGIT), of_byte(_PUNCT)
    out["n_exclaim"], out["n_pipe"] = of_byte(np.arange(256) == 33), of_byte(np.arange(256) == 124)

    within = lambda table: (t := np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64))))[s.end] - t[s.start]
    symbols, uppers, lowers, punct = within(_SYMBOL), within(IS_UPPER), within(IS_LOWER), within(_PUNCT)
    out["n_symbol_words"] = per_doc(symbols > 0)
    out["n_upper_words"] = per_doc((uppers > 1) & (lowers == 0))
    out["n_punct_words"] = per_doc(punct > 1)
    out["n_long_words"] = per_doc(lengths > 15)
    if len(s.end):
        out["n_end_punct"] = per_doc(_PUNCT[buf[s.end - 1]])

    # lines: those with a word, equal to an earlier line of the document
    breaks = np.flatnonzero(_NEWLINE[buf])
    start = np.unique(np.concatenate((s.offsets[:-1], breaks + 1)))
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf))
    end = np.where(_NEWLINE[buf[end - 1]], end - 1, end)
    first_word = np.searchsorted(s.start, start)
    has = (first_word < len(s.start)) & (np.append(s.start, len(buf))[first_word] < end)
    start, end = start[has], end[has]
    line_doc = np.searchsorted(s.offsets, start, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    order, new, _ = _distinct_flags(line_doc, span_hashes(buf, start, end, fold=False))
    out["n_dup_lines"] = np.bincount(line_doc[order[~new]], minlength=n)

    # words: distinct ones, repeats next to each other, words in windows of three found twice
    h = s.hashes(fold=False)
    if len(h):
        order, new, _ = _distinct_flags(word_doc, h)
        out["n_distinct"] = np.bincount(word_doc[order[new]], minlength=n)
        out["n_adjacent"] = per_doc(np.concatenate(([False], (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1]))))
    grams = ngram_hashes(h, 3)
    if len(grams):
        at = np.flatnonzero(word_doc[:-2] == word_doc[2:])
        order, _, run = _distinct_flags(word_doc[at], grams[at])
        twice = at[order[run > 1]]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[twice + k] = True
        out["n_repeat_words"] = per_doc(covered)
    return np.stack([out[c] for c in COUNTS], 1)


def rates(counts: np.ndarray) -> np.ndarray:
    """(documents, len(RATES)) of scale-free statistics; all zero for a text without words."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_punct"] / chars, np.log1p(c["n_words"] / lines), c["n_distinct"] / words ** 0.85, c["n_adjacent"] / words,
        c["n_end_punct"] / words, c["n_symbol_words"] / words, c["n_upper_words"] / words, c["n_punct_words"] / words, c["n_long_words"] / words,
        np.log1p(c["n_words"]), c["n_exclaim"] / words, c["n_pipe"] / words,
    ], 1)


def vectors(schema: pa.Schema, text_index: int, make) -> "callable":
    """A mapInArrow function: make(batch slice columns, counts) -> arrays of schema."""
    from .text import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(text_index), 1 << 20):
                rows = batch.slice(s.first, len(s))
                yield pa.RecordBatch.from_arrays(make(rows, count_statistics(s)), schema=schema)

    return run
