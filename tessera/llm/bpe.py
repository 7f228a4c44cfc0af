"""Byte-level BPE with a transducer of frequent words.

1.  Words (the pieces of the byte-level pattern) are counted over all
    documents, each occurrence: each task counts its own, a shuffle by word adds
    up, and the ``lexicon_size`` most frequent (a parameter; ties by the word's bytes) are
    taken to the driver, which learns first how many words have each count.
2.  Their ids are found by exact merging and the words, in byte order, are
    compiled into a minimal acyclic automaton: equal suffixes share states, and
    each transition carries how many words precede those behind it, so that
    the sum along a word's path is its rank, which gives its ids.  The file
    is shipped to the executors with ``SparkContext.addFile`` and memory-mapped
    there.
3.  A text is cut before every space that a non-space follows (no piece of the
    pattern crosses such a place).  A worker remembers the ids of chunks it has
    met; of new ones, all words walk the automaton at once, and those that it
    does not have are merged exactly, again all at once.  The ids of many texts
    are gathered in one step.
4.  Decoding gathers the bytes of the ids and reads them as UTF-8.

The result does not depend on which words are in the lexicon.

Defined cases: a null or empty text has no ids; the special token's string in a
text is that token; repeated rows stay; an empty table gives an empty lexicon;
extra columns are not read; memory is bounded by the memo's ``limit`` and by a
batch of rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, lean, stored, whole_text
from tessera.llm.encoding import Numbered, byte_letters, parts_ending, runs, sums_to
from tessera.llm.shingles import portions

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

# The white space and the piece pattern of the byte-level tokenizer.
WHITE = "\t-\r \x85\xa0\u1680 - \u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CHUNK = regex.compile(rf"(?= [^{WHITE}])")
#: Where there is one of these, a space may have no other character than a white one behind it.
UNEVEN = [*(" " + x for x in map(chr, range(0x3001)) if x.isspace()), *"\x1c\x1d\x1e\x1f"]

NO_RANK = np.int64(1 << 40)

#: Before a special token among the chunks; no chunk begins so, as a lone half of a pair is no text.
SPECIAL = "\ud800"


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The runs of ``data``, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Merges:
    """The vocabulary: ids of bytes, ranks of pairs, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {x: b for b, x in byte_letters().items()}
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # pairs in a hash table with linear probing: key -> rank
        self.mask = (1 << (len(keys) * 4).bit_length()) - 1
        self.table, self.rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NO_RANK, np.int64)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 1
            while self.table[slot] not in (-1, key):
                slot, n = (slot + 1) & self.mask, n + 1
            if self.table[slot] == -1:
                self.table[slot], self.rank[slot] = key, rank
            self.probes = max(self.probes, n)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        decimals = [b"%d," % i for i in range(size)]
        self.decimal_lengths = np.array([len(x) for x in decimals], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_lengths) - self.decimal_lengths
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.where(self.table[slot] == keys, self.rank[slot], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.table[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            s = slot[open_]
            out[open_] = np.where(self.table[s] == keys[open_], self.rank[s], NO_RANK)
            open_ = open_[(self.table[s] != -1) & (self.table[s] != keys[open_])]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of all words: their ids, word after word, and how many each has.

        In each round every word merges all places of its lowest-ranked pair.  A
        merge only makes pairs of higher rank than its own, so this is the order of
        one merge after another.
        """
        sizes = np.array([len(x) for x in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        done_word, done_symbol = [], []
        while len(word):
            rank = np.full(len(word), NO_RANK, np.int64)
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = NO_RANK
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(np.append(first, len(word))))
            over = least == NO_RANK
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbol[over])
            hit = (rank == least) & ~over
            # of a run of overlapping hits (x x x), the 1st, 3rd, ... are merged
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
            at = np.flatnonzero(hit)
            symbol = symbol.copy()
            symbol[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            word, symbol = word[keep], symbol[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The decimals of the ids, each with a comma behind, and how long each is."""
        lengths = self.decimal_lengths[ids]
        return gather(self.decimals, self.decimal_starts[ids], lengths), lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.spelling, self.starts[ids], self.lengths[ids])


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def compile_lexicon(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A minimal acyclic automaton of the words (distinct, in byte order) with their ids (counts of them each).

    The path of the last word is kept open; as soon as the next word leaves it,
    its tail is frozen and replaced by an equal state if there is one.
    """
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []  # words accepted from a state on

    def freeze(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
            sizes.append(final + sum(sizes[t] for _, t in edges))
        return frozen[key]

    path: list[list] = [[False, []]]  # [final, edges]; the edge to the next open state is not yet in it
    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, edges)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, edges = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(final, edges)))
    root = freeze(*path[0])
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        skip = int(final)
        for label, target in edges:
            keys.append(s << 8 | label)
            targets.append(target)
            skips.append(skip)
            skip += sizes[target]
    arrays = [
        np.array([root], np.int64), np.array([f for f, _ in states], np.int64), np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), ids.astype(np.int64),
    ]
    return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, file: str):
        data = np.asarray(np.memmap(file, np.int64, "r"))
        ends = 7 + np.cumsum(data[:7])
        (root,), self.final, self.keys, self.targets, self.skips, self.starts, self.ids = (data[a:b] for a, b in zip([7, *ends[:-1]], ends, strict=True))
        self.root = int(root)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words take a step at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.array([len(x) for x in words], np.int64)
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        live, state, rank, step = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(live):
            ended = sizes[live] == step
            accepted = ended & (self.final[state] == 1)
            out[live[accepted]] = rank[accepted]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
            key = state << 8 | data[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            live, edge = live[there], edge[there]
            state, rank, step = self.targets[edge], rank[there] + self.skips[edge], step + 1
        return out


def chunks_of(text: str) -> list[str]:
    """The text cut before every space that a non-space follows."""
    if not text:
        return []
    if "\0" in text or text[0] == " " or text[-1] == " " or any(x in text for x in UNEVEN):
        return [x for x in CHUNK.split(text) if x]
    return text.replace(" ", "\0 ").split("\0")


def words_of(chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words of the chunks, in an order of its own; where each chunk is in it; how many words lie up to its end).

    Chunks of a space and what is not white may follow each other in one text: no word crosses
    from one to the next.  Only the others are cut one by one.
    """
    alone = np.array([x[0] != " " or len(x) == 1 or x[1].isspace() for x in chunks], bool)
    order = np.argsort(alone, kind="stable")
    dealt = [chunks[i] for i in order.tolist()]
    n = len(chunks) - int(alone.sum())
    words = [*PIECE.findall("".join(dealt[:n])), *chain.from_iterable(map(PIECE.findall, dealt[n:]))]
    return words, np.argsort(order), parts_ending(words, dealt)


class TransducerEncoder:
    """ids of texts: remembered chunks, else the lexicon, else exact merges."""

    def __init__(self, path: str, lexicon: str, limit: int = 200_000):
        self.merges, self.lexicon, self.known = merges(path), Lexicon(lexicon), Numbered(limit, "<u4")
        special = sorted(map(regex.escape, self.merges.special), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(special) + ")") if special else None

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = np.array([x[0] == SPECIAL for x in new], bool)
        flat, place, ends = words_of([x for x in new if x[0] != SPECIAL])
        number: defaultdict[str, int] = defaultdict(count().__next__)
        of = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        words = [x.encode() for x in number]
        rank = self.lexicon.find(words)
        seen, unseen = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        merged, sizes = self.merges.merge([words[i] for i in unseen.tolist()])
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[seen] = self.lexicon.starts[rank[seen]]
        counts[seen] = self.lexicon.starts[rank[seen] + 1] - starts[seen]
        starts[unseen], counts[unseen] = len(self.lexicon.ids) + np.cumsum(sizes) - sizes, sizes
        special = np.array([self.merges.special[x[1:]] for x in new if x[0] == SPECIAL], np.int64)
        ids = np.concatenate([runs(np.concatenate([self.lexicon.ids, merged]), starts[of], counts[of]), special])
        own = np.concatenate([sums_to(ends, counts[of]), np.ones(len(special), np.int64)])
        at = np.zeros(len(new), np.int64)
        at[~marked], at[marked] = place, len(place) + np.arange(len(special))
        return runs(ids, (np.cumsum(own) - own)[at], own[at]), own[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        flat: list[str] = []
        ends = [len(flat) for text in texts if not flat.extend(self._chunks(text))]
        ids, counts = self.known.ids(self.known.look_up(flat, self._learn))
        return ids, sums_to(np.array(ends, np.int64), counts)

    def _chunks(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [x for i, part in enumerate(parts) for x in ([SPECIAL + part] if i % 2 else chunks_of(part))]
        return chunks_of(text)


@functools.lru_cache(maxsize=2)
def transducer_encoder(path: str, lexicon: str) -> TransducerEncoder:
    return TransducerEncoder(path, lexicon)


#: Characters that are encoded at once, and chunks whose words are told at once: their arrays stay small.
ENCODED, TOLD = 1 << 19, 1 << 17


def word_counts(docs: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """word, n: how often each word of the pattern occurs, exactly, over all documents.

    A task hands on its counts when it holds ``flush`` chunks and at its end.
    """

    def emit(chunks: list[str], n: np.ndarray) -> pd.DataFrame:
        flat, place, ends = words_of(chunks)
        number: defaultdict[str, int] = defaultdict(count().__next__)
        of = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        dealt = np.zeros(len(n), np.int64)
        dealt[place] = n
        total = np.zeros(len(number), np.int64)
        np.add.at(total, of, np.repeat(dealt, np.diff(ends, prepend=0)))
        return pd.DataFrame({"word": pd.Series(list(number), dtype=object), "n": total})

    def told(number: dict[str, int], n: np.ndarray) -> Iterator[pd.DataFrame]:
        chunks = list(number)
        number.clear()
        for at in range(0, len(chunks), TOLD):
            yield emit(chunks[at : at + TOLD], n[at : at + TOLD])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: defaultdict[str, int] = defaultdict(count().__next__)
        n = np.zeros(0, np.int64)
        for batch in batches:
            texts = list(batch["t"])
            for some in portions(texts, ENCODED):
                flat = list(chain.from_iterable(map(chunks_of, texts[some])))
                met = np.bincount(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), minlength=len(number))
                met[: len(n)] += n
                n = met
                if len(n) > flush:
                    yield from told(number, n)
                    number, n = defaultdict(count().__next__), np.zeros(0, np.int64)
        yield from told(number, n)

    rows = docs.select(whole_text(text).alias("t"))
    return rows.mapInPandas(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent words, ties by the word; the driver gets these and one row for each n."""
    n = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toPandas()
    fits = int((n["words"].cumsum() <= size).sum())
    least, rest = (int(n["n"][fits - 1]) if fits else None), size - int(n["words"][:fits].sum())
    found = counts.where(F.col("n") >= least).select("word").toPandas()["word"].tolist() if fits else []
    if rest and fits < len(n):  # of the next n only as many as fit, read in order
        tied = counts.where(F.col("n") == int(n["n"][fits])).select("word").orderBy("word")
        found += [x["word"] for x in islice(tied.toLocalIterator(), rest)]
    return found


def build_lexicon(docs: DataFrame, path: str, lexicon_size: int = 50_000, text: str = "text") -> str:
    """Compile the most frequent words and ship the file; its name for ``SparkFiles.get``."""
    counts = stored(word_counts(docs, text), "word-counts")
    words = sorted({x.encode() for x in most_frequent(counts, lexicon_size)})
    discard(counts)
    data = compile_lexicon(words, *merges(path).merge(words))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    if any(x.endswith(name) for x in docs.sparkSession.sparkContext.listFiles):
        return name
    file = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)  # on the driver, whose file server sends it to every executor
    with open(file, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(file)
    return name


def encode_decode(docs: DataFrame, path: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array), decoded: the ids of each whole text and what they decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = transducer_encoder(path, SparkFiles.get(lexicon))
        for batch in batches:
            texts = list(batch["t"])
            for some in portions(texts, ENCODED):
                flat, counts = encoder.encode(texts[some])
                ids = np.split(flat.astype(np.int64), np.cumsum(counts)[:-1])
                yield pd.DataFrame({key: batch[key].iloc[some], "ids": ids, "decoded": [encoder.merges.decode(x).decode("utf-8", "replace") for x in ids]})

    rows = docs.select(F.col(key).cast("long"), whole_text(text).alias("t"))
    return rows.mapInPandas(lean(run), f"{key} long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str, lexicon: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids): digests of the same ids and texts, made where they arise."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = transducer_encoder(path, SparkFiles.get(lexicon))
        for batch in batches:
            texts = list(batch["t"])
            for some in portions(texts, ENCODED):
                ids, counts = encoder.encode(texts[some])
                ends = np.cumsum(counts)
                decimals, lengths = encoder.merges.decimal(ids)
                to = np.cumsum(sums_to(ends, lengths)).tolist()
                spelled, until = encoder.merges.decode(ids), np.cumsum(sums_to(ends, encoder.merges.lengths[ids])).tolist()
                decoded = [spelled[a:b].decode("utf-8", "replace").encode() for a, b in zip([0, *until], until)]  # noqa: B905
                out = {key: batch[key].iloc[some], "n_tokens": counts}
                out["ids_sha256"] = [hashlib.sha256(decimals[a : max(a, b - 1)]).hexdigest() for a, b in zip([0, *to], to)]  # noqa: B905
                out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
                if with_ids:
                    out["ids"] = np.split(ids.astype("<i4"), ends[:-1])
                yield pd.DataFrame(out)

    rows = docs.select(F.col(key).cast("long"), whole_text(text).alias("t"))
    return rows.mapInPandas(lean(run), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return encode_digest(docs, BYTE_BPE, build_lexicon(docs, BYTE_BPE))
