"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress, islice, repeat

import numpy as np
import pyarrow as pa

#: The pieces that a worker remembers (about 200 bytes each); beyond, it forgets those that it met in one batch only.
REMEMBERED = 300_000
#: Characters of texts that are cut at a time, about.
AT_A_TIME = 2**22
#: What the last piece of a sentence ends with.
SENTENCE_ENDS = (".", "!", "?", "…", "。", ".”", '."', ".)")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces are words with the space before them, and what stands between words.  Byte-level
#: pre-tokenization has a boundary at each of these cuts, and what it makes of a piece
#: doesn't depend on its neighbours ...
_WORD = re.compile(rf" ?[{_LETTER}]+")
#: ... except around apostrophes, other scripts' characters, and white space of several characters that doesn't end in a space.
#: There, texts are only cut before a single space or line break between other characters (the same as _coarse).
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A character that no word has, as text or in the alphabet of bytes.
_NOT_IN_WORDS = re.compile(r"[!-@\[-`{-~]")


def _bytes_of(chars: str) -> np.ndarray:
    """A table of bytes: whether one is a character of chars."""
    table = np.zeros(256, bool)
    table[list(chars.encode("latin-1"))] = True
    return table


#: In texts of these letters and ASCII, a byte over 127 belongs to a letter.
_IS_LETTER = _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) > 127)
#: White space other than the space.
_IS_BREAK = _bytes_of("\t\n\v\f\r\x1c\x1d\x1e\x1f")
#: White space beyond ASCII, by its bytes.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in range(128, 0x3001) if chr(c).isspace()])
#: Apostrophes, and first bytes of characters below À or over ɏ.
_IS_ODD = _bytes_of("'\xc2") | (np.arange(256) > 0xC9)


def _odd(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts that lie between bounds in data have something that pieces depend on their neighbours around."""
    odd = _IS_ODD[data]
    first, second = data[:-1], data[1:]
    odd[:-1] |= (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F)  # × and ÷, and from U+0250 on
    white = _IS_BREAK[data]
    runs = white[1:] & (white[:-1] | (first == 32))
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    runs[inner - 1] = False  # another text begins there
    odd[1:] |= runs
    found = np.zeros(len(bounds) - 1, bool)
    found[np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1] = True
    return found


def _begins(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """At which bytes pieces begin, of texts without anything odd."""
    letter = _IS_LETTER[data]
    before = np.zeros(len(data), bool)  # spaces that a word follows
    before[:-1] = (data[:-1] == 32) & letter[1:]
    before[bounds[1:][bounds[1:] > 0] - 1] = False
    word = letter | before
    begins = before
    begins[1:] |= word[1:] != word[:-1]
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    return begins


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


def _coarse(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """At which bytes pieces begin, of any texts."""
    white = _IS_BREAK[data] | (data == 32)
    for width, first in ((2, data == 0xC2), (3, (data > 0xE0) & (data < 0xE4))):
        at = np.flatnonzero(first)
        code = np.zeros(len(at), np.int64)
        for k in range(width):
            code = code << 8 | data[at + k]
        at = at[np.isin(code, _WIDE)]
        white[at] = white[at + width - 1] = True
    begins = np.zeros(len(data), bool)
    begins[1:-1] = ((data == 32) | (data == 10))[1:-1] & ~white[:-2] & ~white[2:]
    begins[bounds[1:][bounds[1:] > 0] - 1] = False  # what comes next is another text's
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    return begins


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of so many places from each start, one after the other."""
    step = np.repeat(start - (np.cumsum(size, dtype=size.dtype) - size), size)
    step += np.arange(len(step), dtype=step.dtype)
    return step


class Encoder:
    """Encodes texts with a tokenizer file as the library does without adding special tokens.

    Strings of the file's added tokens (such as <|endoftext|>) in a text give those
    tokens; with plain=True they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        added = sorted((x.content for x in self._tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = [] if plain else added
        self._around = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.vocabulary = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 2**16 else "<u4")
        # A word with the space before it is one unit of pre-tokenization, so lines of single words, in the alphabet of bytes, need no pattern.
        self._lines = Tokenizer.from_file(path)
        self._lines.encode_special_tokens = plain
        self._lines.pre_tokenizer = pre_tokenizers.Split(_ALPHABET[10], "isolated")
        self._line = self._tokenizer.token_to_id(_ALPHABET[10])
        self._by_line = self._line is not None and self._tokenizer.normalizer is None and all(_NOT_IN_WORDS.search(x) for x in added)
        self._codes: dict[str, int] = {}
        self._ids = np.empty(0, self.dtype)
        self._start, self._size, self._again = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self._ends = np.empty(0, bool)

    def _split(self, text: str) -> list[str]:
        """The pieces of a text with added tokens, each of them being one of its own."""
        parts = self._around.split(text)
        return [p for k, part in enumerate(parts) if part for p in ([part] if k % 2 else _CUT.split(part))]

    def _pieces(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of all texts whose ids, one after the other, are the ids of the texts, and where the pieces of each begin."""
        raw = [t.encode() for t in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        begins, odd = _begins(data, bounds), _odd(data, bounds)
        if odd.any():
            begins = np.where(np.repeat(odd, np.diff(bounds)), _coarse(data, bounds), begins)
        for k, text in enumerate(texts):
            if any(x in text for x in self._added):
                begins[bounds[k] : bounds[k + 1]] = False
                begins[bounds[k] + np.cumsum([0, *(len(p.encode()) for p in self._split(text))][:-1])] = True
        at = np.r_[np.flatnonzero(begins), len(data)]
        found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))
        return found.dictionary_encode(), np.searchsorted(at, bounds)

    def _forget(self) -> None:
        """Forgets the pieces that no later batch has met again, and of the others those beyond half of what may be remembered."""
        keep = np.flatnonzero(self._again)[: REMEMBERED // 2]
        marks = np.zeros(len(self._again), bool)
        marks[keep] = True
        self._codes = dict(zip(compress(self._codes, marks.tolist()), range(len(keep))))
        size = self._size[keep]
        self._ids = self._ids[_runs(self._start[keep], size)]
        self._start, self._size, self._again = np.cumsum(size) - size, size, np.zeros(len(keep), bool)
        self._ends = self._ends[keep]

    def _learn(self) -> None:
        """Encodes the pieces that have a number but no ids yet: words in rows of some hundred, a line each."""
        new = list(islice(self._codes, len(self._start), None))
        is_word = np.fromiter(map(bool, map(_WORD.fullmatch, new)), bool, len(new)) & self._by_line
        words, rest = list(compress(new, is_word.tolist())), list(compress(new, (~is_word).tolist()))
        rows = ["\n".join([*words[at : at + 400], ""]).encode().decode("latin-1").translate(_ALPHABET) for at in range(0, len(words), 400)]
        found = [e.ids for e in self._lines.encode_batch_fast(rows, add_special_tokens=False)]
        lines = np.fromiter(chain.from_iterable(found), self.dtype, sum(map(len, found)))
        is_end = lines == self._line if rows else np.zeros(0, bool)
        others = [e.ids for e in self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        count = np.fromiter(map(len, others), np.int64, len(others))
        size, start = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        size[is_word], size[~is_word] = np.diff(np.flatnonzero(is_end), prepend=-1) - 1, count
        order = np.r_[np.flatnonzero(is_word), np.flatnonzero(~is_word)]
        start[order] = len(self._ids) + np.cumsum(size[order]) - size[order]
        self._start, self._size, self._again = np.r_[self._start, start], np.r_[self._size, size], np.r_[self._again, np.zeros(len(new), bool)]
        ends = np.zeros(len(new), bool)
        ends[~is_word] = [p.endswith(SENTENCE_ENDS) for p in rest]
        self._ends = np.r_[self._ends, ends]
        self._ids = np.concatenate([self._ids, lines[~is_end], np.fromiter(chain.from_iterable(others), self.dtype, count.sum())])

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(self._codes) > REMEMBERED:
            self._forget()
        found, bounds = self._pieces(texts)
        known, distinct = len(self._codes), found.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self._codes.get, distinct, repeat(-1)), np.int64, len(distinct))
        self._again[codes[codes >= 0]] = True
        new = np.flatnonzero(codes < 0)
        if len(new):
            codes[new] = known + np.arange(len(new))
            self._codes.update(zip(distinct[new].tolist(), range(known, known + len(new))))
            self._learn()
        # what these texts need is gathered first, so that the many places are looked up in small tables
        few, code = self._size[codes].astype(np.int32), found.indices.to_numpy()
        table = self._ids[_runs(self._start[codes], self._size[codes])]
        size, ends = few[code], self._ends[codes][code]
        ids = table[_runs((np.cumsum(few, dtype=np.int32) - few)[code], size)]
        at = np.r_[0, np.cumsum(size)][bounds]
        for k in range(len(texts)):
            mine = slice(bounds[k], bounds[k + 1])
            yield ids[at[k] : at[k + 1]], size[mine], ends[mine]

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, the number of ids of each of its pieces, and whether a sentence ends with the piece."""
        part, chars = [], 0
        for text in texts:
            part.append(text)
            chars += len(text)
            if chars >= AT_A_TIME:
                yield from self._encode(part)
                part, chars = [], 0
        if part:
            yield from self._encode(part)

    def ids(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [found for found, _, _ in self.encode(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """The file of the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
