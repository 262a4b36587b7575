"""Token ids of whole texts with a public tokenizer, fast where words repeat.

A text whose every space stands between two non-white characters is cut at its
spaces. The vocabularies here never let a token reach over such a cut, so the ids
of the pieces in a row are the ids of the text, and a piece is encoded once for a
worker, not once for each time it occurs. Any other text is encoded as a whole, and
so is a text that holds an added token's string (``<|endoftext|>``, say, in any
case), which the library takes for that token.

``space_leads`` tells the two kinds of vocabulary apart: with it, a piece keeps
the space before it (byte-level vocabularies); without, white space is dropped,
letters are lower-cased and words have an end (word vocabularies).

A piece that is letters and then perhaps common punctuation is two units, since
both kinds cut there. New words of letters are encoded many at a time, by the
same model behind a cut at spaces alone; the marks that a word's first (or last)
token bears tell the words apart again, and a chunk whose marks do not add up is
encoded word by word.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: A space or a line's end at an end of the text or beside white space.
_ODD = rf"(?:^|{_WHITE})[ \n]|[ \n](?:{_WHITE}|$)"
#: Letters that case and composition treat one by one, and punctuation that tokens do not share with letters.
_LETTERS, _TAIL = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$", ".,;:!?"
#: Bytes of text encoded at once, and units that a worker remembers.
SLICE, REMEMBERED = 4 << 20, 500_000

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, space_leads: bool) -> "Encoder":
    """This process's encoder for a vocabulary file."""
    if (path, space_leads) not in _encoders:
        _encoders[path, space_leads] = Encoder(path, space_leads)
    return _encoders[path, space_leads]


class Encoder:
    def __init__(self, path: str, space_leads: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *(f"(?i:{re.escape(x)})" for x in added)])
        self.space_leads = space_leads
        self.words = Tokenizer(self.tokenizer.model)
        cut = pre_tokenizers.Split(" ", "merged_with_next") if space_leads else pre_tokenizers.WhitespaceSplit()
        self.words.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin (or end) a word
        for token, i in vocabulary.items():
            self.marked[i] = token.startswith("Ġ") if space_leads else token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, units: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        first = len(self.known)
        self.ids = _room(self.ids, self.used + len(flat))
        self.start, self.length = _room(self.start, first + len(units)), _room(self.length, first + len(units))
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[first : first + len(units)] = length
        self.start[first : first + len(units)] = self.used + np.cumsum(length) - length
        self.used += len(flat)
        self.known.update(zip(units, range(first, first + len(units))))

    def _learn_singly(self, units: list[str]) -> None:
        for low in range(0, len(units), 20_000):
            some = units[low : low + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self._learn(some, np.array(list(itertools.chain.from_iterable(ids)), np.uint32), length)

    def _learn_words(self, units: list[str]) -> None:
        """Words of letters (each with its space before it, if spaces lead), many at a time."""
        for low in range(0, len(units), 20_000):
            some = units[low : low + 20_000]
            texts = [("" if self.space_leads else " ").join(some[k : k + 500]) for k in range(0, len(some), 500)]
            flat = np.array(list(itertools.chain.from_iterable(e.ids for e in self.words.encode_batch_fast(texts, add_special_tokens=False))), np.uint32)
            at = np.flatnonzero(self.marked[flat])
            if len(at) != len(some) or len(at) and (at[0] != 0 if self.space_leads else at[-1] != len(flat) - 1):
                self._learn_singly(some)
                continue
            length = np.diff(np.append(at, len(flat))) if self.space_leads else np.diff(np.append(-1, at))
            self._learn(some, flat, length)

    def _places(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where units are kept: words of letters, and others; each list without repeats."""
        if len(self.known) > REMEMBERED:
            self.forget()
        return self._place(words, self._learn_words), self._place(others, self._learn_singly)

    def _place(self, units: list[str], learn) -> np.ndarray:
        at = np.fromiter(map(self.known.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0)
        first = len(self.known)
        learn([units[i] for i in new.tolist()])
        at[new] = first + np.arange(len(new))  # what is learned is kept in its order
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (one entry more)."""
        texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
        odd = np.asarray(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False), bool)
        # a line's end is a cut too: white space is dropped, or it is a piece of its own
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n " if self.space_leads else " "), " ")
        pieces = split.flatten()
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        simple = np.repeat(~odd, np.diff(bounds))
        if self.space_leads:
            ends = np.asarray(pc.equal(pieces, "\n").to_numpy(zero_copy_only=False), bool)
            lead = ~ends  # pieces with a space before them
            lead[1:] &= ~ends[:-1]
            lead[bounds[:-1]] = False
            units = self._units(pieces, [(simple & lead, " "), (simple & ~lead, None)])
        else:
            units = self._units(pieces, [(simple, "")])
        length = self.length[units]
        length[units < 0] = 0
        total = np.concatenate([[0], np.cumsum(length.sum(axis=1))])
        sizes = total[bounds[1:]] - total[bounds[:-1]]
        ids = self._gather(units.ravel(), length.ravel())
        whole = {i: np.array(self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, np.uint32) for i in np.flatnonzero(odd).tolist()}
        if whole:
            parts, low = [], 0
            for i, own in whole.items():
                parts += [ids[low : total[bounds[i]]], own]
                low = total[bounds[i]]
                sizes[i] = len(own)
            ids = np.concatenate([*parts, ids[low:]])
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _units(self, pieces: pa.Array, groups: list[tuple[np.ndarray, str | None]]) -> np.ndarray:
        """The place of each piece's one or two units, -1 for none.

        A group is some of the pieces and what stands before them; None: nothing,
        so that their words bear no mark and are encoded one by one.
        """
        words, others, todo = [], [], []
        for which, before in groups:
            coded = pieces.filter(pa.array(which)).dictionary_encode()
            own, space = coded.dictionary, before or ""
            bare = pc.utf8_rtrim(own, _TAIL)
            plain = np.asarray(pc.match_substring_regex(bare, _LETTERS).to_numpy(zero_copy_only=False), bool)
            stems = bare.filter(pa.array(plain))
            stems = (stems if self.space_leads else pc.utf8_lower(stems)).dictionary_encode()
            stem_texts = _listed(stems.dictionary, space)
            tailed = plain & (pc.binary_length(own).to_numpy() > pc.binary_length(bare).to_numpy()) if len(own) else plain
            tails = pc.extract_regex(own.filter(pa.array(tailed)), f"(?P<tail>[{_TAIL}]+)$").field("tail").dictionary_encode()
            tail_texts = tails.dictionary.to_pylist()
            rest = [space + x for x in own.filter(pa.array(~plain)).to_pylist()]
            others += [tail_texts, rest] if before is not None else [tail_texts, rest, stem_texts]
            words += stem_texts if before is not None else []
            todo.append((which, before, coded, plain, stems, stem_texts, tailed, tails, tail_texts, rest))
        unique = list(dict.fromkeys(itertools.chain.from_iterable(others)))
        # nothing is forgotten between these look-ups
        word_at, other_at = self._places(words, unique)
        where = dict(zip(unique, other_at.tolist()))
        out = np.full((len(pieces), 2), -1, np.int64)
        for which, before, coded, plain, stems, stem_texts, tailed, tails, tail_texts, rest in todo:
            if not len(coded):
                continue
            unit = np.full((len(plain), 2), -1, np.int64)
            at = word_at if before is not None else np.array([where[x] for x in stem_texts], np.int64)
            if len(stem_texts):
                unit[plain, 0] = at[stems.indices.to_numpy()]
            unit[~plain, 0] = [where[x] for x in rest]
            if len(tail_texts):
                unit[tailed, 1] = np.array([where[x] for x in tail_texts], np.int64)[tails.indices.to_numpy()]
            out[which] = unit[coded.indices.to_numpy()]
        return out

    def _gather(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = int(length.sum())
        some = length > 0
        place, length = place[some], length[some]
        shift = self.start[place] - (np.cumsum(length) - length)
        return self.ids[np.repeat(shift, length) + np.arange(n)]


def _listed(words: pa.Array, before: str) -> list[str]:
    """Words of letters as a list, each with ``before`` in front of it: one text, cut."""
    if not len(words):
        return []
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n" + before)
    return (before + lines[0].as_py()).split("\n")


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids and then ``end``."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
