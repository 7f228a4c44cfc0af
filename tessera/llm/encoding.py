"""Encoding of whole texts with a public tokenizer, by remembered pieces.

A tokenizer that drops white space treats the pieces between it independently,
so a worker asks the tokenizers library only for pieces that it has not met
lately and gathers the stored ids of all others at once.  New pieces of Latin-1
characters are normalised and cut by the tokenizer's own rules here, and all
words that are new in a batch go to the library's model in one call, which skips
its costly per-text set-up; all others take the library's whole way.  The
memories of pieces and of words are bounded by ``limit``; of a full one the half
that was met most stays.
"""

from __future__ import annotations

import functools
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.shingles import portions

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: utf8_split_whitespace also splits at these, which are not white space to the tokenizer.
NOT_WHITE = re.compile("[\x1c-\x1f]")

# The word pattern of the word-level tokenizer, its classes within Latin-1 (in lower case).
LETTER, NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


class Remembered(dict):
    """Pieces and what they become; one that is not there is noted and gives None.

    When it has ``limit`` pieces it becomes the older half, from which pieces
    still in use come back.
    """

    def __init__(self, limit: int):
        self.asked: list[str] = []
        self.older: dict = {}
        self.limit = limit

    def __missing__(self, piece: str):
        if (found := self.older.get(piece)) is not None:
            self[piece] = found
            return found
        self.asked.append(piece)
        return None

    def look_up(self, texts: Iterable[list[str]], learn: Callable[[set[str]], None]) -> Iterator[list]:
        """What is remembered of the pieces of each text, after ``learn`` has put in those that are new."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        self.asked = asked = []
        flat: list[str] = []
        ends = [len(flat) for pieces in texts if not flat.extend(pieces)]
        parts = list(map(self.__getitem__, flat))
        if asked:
            self.asked = []
            learn(set(asked))
            at = -1
            for new in map(self.__getitem__, asked):
                at = parts.index(None, at + 1)
                parts[at] = new
        for begin, end in zip([0, *ends], ends):  # noqa: B905
            yield parts[begin:end]


def runs(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` entries of ``pool`` from ``starts[i]`` on, run after run."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(len(at))
    return pool[at]


def sums_to(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of ``counts`` between one end (an index behind the last) and the next."""
    return np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])])


def parts_ending(parts: list[str], wholes: list[str]) -> np.ndarray:
    """How many of ``parts`` lie before the end of each of ``wholes``, which are the same characters."""
    part_ends, ends = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (parts, wholes))
    behind = np.searchsorted(part_ends, ends) + 1
    if len(part_ends) != (behind[-1] if len(behind) else 0) or (part_ends[behind - 1] != ends).any():
        raise ValueError("parts that are not cut from the wholes")
    return behind


def put_in(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``array``, of which ``at`` entries are used, with ``new`` behind them; a full one is copied to twice its room."""
    if at + len(new) > len(array):
        old, array = array, np.zeros(max(2 * len(array), at + len(new)), array.dtype)
        array[:at] = old[:at]
    array[at : at + len(new)] = new
    return array


class Numbered:
    """Pieces by number, and the ids that each becomes, in one pool.

    A piece that is not there gets the next number; all new ones of a call are
    learnt together.  Above ``limit`` pieces, the half that was met most stays.
    """

    def __init__(self, limit: int, dtype):
        self.limit = limit
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.pool, self.used = np.zeros(0, dtype), 0  # all arrays have room to spare
        self.starts = self.counts = self.met = np.zeros(0, np.int64)

    def look_up(self, pieces: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], times: np.ndarray | None = None) -> np.ndarray:
        """The number of each piece; ``learn`` gives the ids of new ones, one after the other, and how many each has.

        ``times`` has how often each of different pieces was met.
        """
        if len(self.number) > self.limit:
            self._shrink()
        before = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.number) > before:
            ids, counts = learn(list(islice(reversed(self.number), len(self.number) - before))[::-1])
            self.starts = put_in(self.starts, before, self.used + np.cumsum(counts) - counts)
            self.counts = put_in(self.counts, before, counts)
            self.met = put_in(self.met, before, np.zeros(len(counts), np.int64))
            self.pool, self.used = put_in(self.pool, self.used, ids), self.used + len(ids)
        times = np.bincount(found, times).astype(np.int64)
        self.met[: len(times)] += times
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces, one after the other, and how many each has."""
        counts = self.counts[numbers]
        return runs(self.pool, self.starts[numbers], counts), counts

    def _shrink(self) -> None:
        pieces = list(self.number)
        keep = np.sort(np.argsort(-self.met[: len(pieces)], kind="stable")[: self.limit // 2])
        self.pool, self.counts = self.ids(keep)
        self.used = len(self.pool)
        self.starts, self.met = np.cumsum(self.counts) - self.counts, self.met[keep] // 2
        self.number = defaultdict(count(len(keep)).__next__, zip(map(pieces.__getitem__, keep.tolist()), range(len(keep)), strict=True))


class PieceEncoder:
    """ids of texts as little-endian unsigned bytes, ``width`` bytes an id."""

    def __init__(self, path: str, width: int, special_as_text: bool, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype(f"<u{width}")
        self.known, self.words = Numbered(limit, self.dtype), Numbered(limit, self.dtype)
        # the same model behind a cut at white space, for words in the letters of a byte-level vocabulary
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        # what a special token's string can be part of takes the library's way, unless it is ordinary text
        self.special = None if special_as_text else re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()))

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All new words in one text for the model; every word ends with the one id that ends a word."""
        spelled = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(LETTERS) for w in words]
        ids = np.array(self.model.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the model left out a letter")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = "\n".join(new)
        hard = set() if latin(lines) else {i for i, x in enumerate(new) if not latin(x)}
        if self.special and self.special.search(lines):
            hard |= {i for i, x in enumerate(new) if self.special.search(x)}
        if "" in new:  # of white space at an end of a text
            hard.add(new.index(""))
        easy = [x for i, x in enumerate(new) if i not in hard] if hard else new
        words = WORDS.findall("\n".join(easy).lower())  # as long as before: Latin-1 letters have one small letter
        ids, counts = self.words.ids(self.words.look_up(words, self._learn_words))
        counts = sums_to(parts_ending(words, easy), counts)
        if not hard:
            return ids, counts
        asked = self._ask([new[i] for i in sorted(hard)])
        ids = np.concatenate([ids, np.frombuffer(b"".join(asked), self.dtype)])
        counts = np.concatenate([counts, np.array([len(x) // self.dtype.itemsize for x in asked], np.int64)])
        place = np.argsort(np.argsort([i in hard for i in range(len(new))], kind="stable"))
        return runs(ids, (np.cumsum(counts) - counts)[place], counts[place]), counts[place]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for some in portions(texts, 1 << 21) for x in self._encode(texts[some])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, x in enumerate(texts) if NOT_WHITE.search(x)]
        for i, ids in zip(odd, self._ask([texts[i] for i in odd]), strict=True):
            out[i] = ids
        aside = set(odd)
        plain = [i for i in range(len(texts)) if i not in aside]
        cut = pc.utf8_split_whitespace(pa.array([texts[i] for i in plain], pa.string()))
        pieces, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy()[1:]
        of = pieces.indices.to_numpy()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, counts = self.known.ids(self.known.look_up(different, self._learn, np.bincount(of, minlength=len(different)))[of])
        data, cuts = ids.tobytes(), (np.cumsum(sums_to(ends, counts)) * self.dtype.itemsize).tolist()
        for i, a, b in zip(plain, [0, *cuts], cuts):  # noqa: B905
            out[i] = data[a:b]
        return out


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=4)
def piece_encoder(path: str, width: int = 4, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(path, width, special_as_text)


def id_width(path: str) -> int:
    """Bytes that an id of this tokenizer needs."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
