"""Whole texts to token ids with a public tokenizer, each distinct word being encoded once a worker.

A text is cut before white space that follows something else; there, neither tokenizer of this module ever joins
(the byte-level pattern has no token that goes from another character into white space, and the word-level one drops
white space). Words whose last character is white space outside ASCII would be an exception; texts that hold one are
encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from broadsheet.llm import wordhash

#: Words that a worker remembers before it starts anew.
MOST_WORDS = 1_500_000
#: New words that one call of the tokenizer takes together.
GROUP = 64
STEP_BYTES = 2 << 20
END_ID = 1

_encoders: dict[tuple[str, bool], CachedEncoder] = {}


class CachedEncoder:
    """``keep_space``: white space is part of tokens (byte-level); else it only separates."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space = keep_space
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of text that an id stands for; byte-level tokens spell each byte as one character.
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token.removesuffix("</w>"))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # word hashes in order, and their rows
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n_rows, self.n_ids = 0, 0

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words that are each encoded as a text of its own."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same by one call over all the words; None where their ids can't be told apart by their bytes."""
        if self.keep_space:
            text = "".join(words)
            sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        else:
            text = self.tokenizer.normalizer.normalize_str(" ".join(words))
            if len(parts := text.split(" ")) != len(words):
                return None
            sizes = np.fromiter((len(w.encode()) for w in parts), np.int64, len(parts))
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        behind = np.cumsum(self.id_bytes[ids])
        cuts = np.searchsorted(behind, np.cumsum(sizes))
        if len(ids) == 0 or cuts[-1] != len(ids) - 1 or (behind[cuts] != np.cumsum(sizes)).any():
            return None
        return ids, np.diff(cuts + 1, prepend=0)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids, GROUP words at a time where they can be joined without changing their tokens."""
        space = " \t\n\r\x0b\x0c"
        joins = [len(w) < 256 and (w[0] in space and w[-1] not in space if self.keep_space else True) for w in words]
        group = [i for i, ok in enumerate(joins) if ok]
        rest = [i for i, ok in enumerate(joins) if not ok]
        order, ids, lengths = [], [], []
        for k in range(0, len(group), GROUP):
            part = group[k : k + GROUP]
            if (got := self._together([words[i] for i in part])) is None:
                rest += part
                continue
            order.append(part)
            ids.append(got[0])
            lengths.append(got[1])
        if rest:
            got = self._alone([words[i] for i in rest])
            order.append(rest)
            ids.append(got[0])
            lengths.append(got[1])
        place, ids, lengths = np.concatenate(order), np.concatenate(ids), np.concatenate(lengths)
        back = np.argsort(place)
        starts = (np.cumsum(lengths) - lengths)[back]
        return ids[wordhash.ragged(starts, lengths[back])], lengths[back]

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, lengths = self._encode_words(words)
        n = len(words)
        total = int(lengths.sum())
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_rows + n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.n_ids : self.n_ids + total] = ids
        self.at[self.n_rows + 1 : self.n_rows + n + 1] = self.n_ids + np.cumsum(lengths)
        at = np.searchsorted(self.keys, hashes)
        self.row_of = np.insert(self.row_of, at, np.arange(self.n_rows, self.n_rows + n, dtype=np.int32))
        self.keys = np.insert(self.keys, at, hashes)
        self.n_rows += n
        self.n_ids += total

    def _pieces(self, texts: wordhash.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of what is encoded on its own."""
        starts, ends, doc = texts.starts, texts.ends, texts.doc
        if self.keep_space:
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
            opens = texts.first[:-1][texts.n_words > 0]
            starts[opens] = texts.bounds[:-1][texts.n_words > 0]
            last = np.where(texts.n_words > 0, ends[np.maximum(texts.first[1:] - 1, 0)] if len(ends) else 0, texts.bounds[:-1])
            tail = np.flatnonzero(texts.bounds[1:] > last)
            if len(tail):  # white space at the end of a text
                order = np.argsort(np.concatenate([doc, tail]), kind="stable")
                starts = np.concatenate([starts, last[tail]])[order]
                ends = np.concatenate([ends, texts.bounds[1:][tail]])[order]
                doc = np.concatenate([doc, tail])[order]
        return starts, ends, doc

    def _odd(self, texts: wordhash.Texts) -> np.ndarray:
        """Texts with a word that ends in white space outside ASCII."""
        if not self.keep_space or not len(texts.ends):
            return np.zeros(0, np.int64)
        b = np.concatenate([np.zeros(3, np.uint8), texts.buf])
        last, second, third = (b[texts.ends + k] for k in (2, 1, 0))
        odd = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
        odd |= (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        odd |= (third == 0xE2) & (second == 0x81) & (last == 0x9F)
        odd |= (third == 0xE1) & (second == 0x9A) & (last == 0x80)
        odd |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
        return np.unique(texts.doc[odd])

    def encode(self, texts: wordhash.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's begin (and the last ends)."""
        n = len(texts.bounds) - 1
        starts, ends, doc = self._pieces(texts)
        if len(odd := self._odd(texts)):
            keep = ~np.isin(doc, odd)
            doc = np.concatenate([doc[keep], odd])
            order = np.argsort(doc, kind="stable")
            starts = np.concatenate([starts[keep], texts.bounds[odd]])[order]
            ends = np.concatenate([ends[keep], texts.bounds[odd + 1]])[order]
            doc = doc[order]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        hashes = wordhash.byte_hashes(texts.buf, starts, ends)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n_rows + len(unique) > MOST_WORDS:
            self._forget()
        row = np.full(len(unique), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            row = np.where(self.keys[at] == unique, self.row_of[at], -1).astype(np.int64)
        if len(new := np.flatnonzero(row < 0)):
            data = texts.buf.tobytes()
            at = where[new]
            words = [data[s:e].decode("utf-8") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            row[new] = np.arange(self.n_rows, self.n_rows + len(new))
            self._add(unique[new], words)
        row = row[back]
        lengths = self.at[row + 1] - self.at[row]
        ids = self.ids[wordhash.ragged(self.at[row], lengths)]
        counts = np.bincount(doc, weights=lengths, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def with_end(self, texts: wordhash.Texts, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), each text's ids being followed by ``end_id``."""
        ids, at = self.encode(texts)
        return np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))


def encoder(path: str, keep_space: bool) -> CachedEncoder:
    """This worker's encoder; it outlives a task, as the words it knows are worth keeping."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = CachedEncoder(path, keep_space)
    return _encoders[path, keep_space]


def text_steps(batch: pa.RecordBatch, text_col: str = "text"):
    return wordhash.steps(batch.column(batch.schema.get_field_index(text_col)), STEP_BYTES)
