"""Ids of whole texts by a public tokenizer file, many texts at a time.

The tokenizers library does all encoding. Words recur, so a slice of texts is split into words by Arrow,
each different word is encoded once, and the texts' ids are put together from the words' ids by numpy.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from hammerline.llm.common import give_back, kept

#: A byte-level tokenizer file whose ids of a text follow from those of its words (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: White space by any definition, for a space behind it (RE2 syntax); letters and digits that end a piece
#: before any mark; marks that are split off the end of a word (fixed values).
SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}] "
LETTER_ENDS = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"
ODD_WORD = r"^$|^[\t-\r\x1c-\x20\x{85}\p{Z}]|[\t-\r\x1c-\x20\x{85}\p{Z}]$"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Bytes of text encoded at a time; bytes of words that are remembered.
SLICE_BYTES, MEMO_BYTES = 1_000_000, 20_000_000
#: A long text is cut before a space between two letters or digits about every so many characters.
CUT = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(vocabulary: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary_size(vocabulary: str) -> int:
    """One more than the largest id."""
    return max(load(vocabulary).get_vocab(with_added_tokens=True).values()) + 1


def id_width(vocabulary: str) -> int:
    """Bytes that hold any id: 2 or 4."""
    return 2 if vocabulary_size(vocabulary) <= 1 << 16 else 4


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values at the starts, one behind the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """The texts' ids with end_id behind each text's."""
    out = np.full(len(ids) + len(sizes), end_id, "<u4")
    kept = np.ones(len(out), bool)
    kept[np.cumsum(sizes + 1) - 1] = False
    out[kept] = ids
    return out


class _Memo:
    """Ids of words seen lately; it starts anew where it outgrows its limit. Words are found by their hashes, which
    are kept in order, and compared: no table of all words is built for a slice."""

    def __init__(self) -> None:
        self.words, self.ids, self.starts, self.counts = pa.array([], pa.string()), *(np.zeros(0, k) for k in ("<u4", np.int32, np.int32))
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' places, -1 for those not known, and their hashes."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
        if not len(self.hashes):
            return np.full(len(words), -1), hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        places = self.places[at[hit]]
        same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(places))).to_numpy(zero_copy_only=False)
        found = np.full(len(words), -1)
        found[hit[same]] = places[same]
        return found, hashes

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.words.nbytes + self.ids.nbytes + 20 * len(self.words) > MEMO_BYTES:
            self.__init__()
        starts, counts = (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32), counts.astype(np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, at, (len(self.words) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.words, self.ids = pa.concat_arrays([self.words, words]), np.concatenate([self.ids, ids])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])


class Encoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) of the library does.

    With a byte-level tokenizer file a piece never reaches over white space that follows a character of
    another kind, so such texts are encoded word by word. A text that holds an added token's string, or
    a space behind white space, is encoded whole by the library, and so are all texts with other files.
    Null counts as empty.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer, self.memo = load(vocabulary), _Memo()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        splitting = self.tokenizer.pre_tokenizer  # asked of the one loaded tokenizer: a worker's memory is dear
        splitting = json.loads(splitting.__getstate__()) if splitting is not None else {}
        plain = self.tokenizer.normalizer is None and all(splitting.get(k) == v for k, v in BYTE_LEVEL.items())
        self.by_words = plain and type(self.tokenizer.model).__name__ == "BPE" and not any(c.isspace() for t in self.added for c in t)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, each text by the library."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum())), counts

    def cuts(self, text: str) -> list[str]:
        """The text in parts of about CUT characters whose ids are those of the text."""
        parts = []
        while self.by_words and len(text) > CUT:
            at = text.find(" ", CUT)
            while at > 0 and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            parts.append(text[:at])
            text = text[at:]
        return [*parts, text]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, a space before each. Words without white space at an end go through the
        library many at a time: in what it returns, only a word's first token opens with the space."""
        easy = pc.invert(pc.match_substring_regex(words, ODD_WORD))
        simple, odd = words.filter(easy), words.filter(pc.invert(easy)).to_pylist()
        edges = np.append(np.arange(0, len(simple), 2000), len(simple)).astype(np.int32)
        parts, sizes = [], []
        for k, line in enumerate(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), simple), " ").to_pylist()):
            ids, _ = self._whole([" " + line])
            first = np.flatnonzero(self.opens[ids])
            some = np.diff(np.append(first, len(ids)))
            if len(some) != edges[k + 1] - edges[k]:  # not to be expected
                ids, some = self._whole([" " + w for w in simple[edges[k] : edges[k + 1]].to_pylist()])
            parts.append(ids)
            sizes.append(some)
        ids, some = self._whole([" " + w for w in odd])
        easy, parts, sizes = easy.to_numpy(zero_copy_only=False), np.concatenate([*parts, ids]), np.concatenate([*sizes, some])
        if not odd:
            return parts, sizes
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        counts, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        counts[order], starts[order] = sizes, np.cumsum(sizes) - sizes
        return gather(parts, starts, counts), counts

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, a space before each, by way of the memo."""
        at, hashes = self.memo.find(words)
        n, old = np.empty(len(words), np.int64), at >= 0
        new = words.filter(pa.array(~old))
        ids, counts = self._words(new)
        n[old], n[~old] = self.memo.counts[at[old]], counts
        starts = np.empty(len(words), np.int64)
        starts[old], starts[~old] = self.memo.starts[at[old]], len(self.memo.ids) + np.cumsum(counts) - counts
        found = gather(np.concatenate([self.memo.ids, ids]), starts, n)
        self.memo.add(new, hashes[~old], ids, counts)
        return found, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, their number in each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            return self._whole(texts.to_pylist())
        whole = pc.match_substring_regex(texts, SPACES)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        split = pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), texts), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        parts = split.flatten().cast(pa.string()).dictionary_encode()
        firsts = parts.take(pa.array(ends[:-1])).cast(pa.string()).to_pylist()
        found, counts = self._word_table(parts.dictionary)
        at = parts.indices.to_numpy()
        starts, n = (np.cumsum(counts) - counts)[at], counts[at]
        # What stands before a text's first space has no space before it; texts encoded whole have no other part.
        heads, sizes = self._whole(firsts)
        starts[ends[:-1]], n[ends[:-1]] = len(found) + np.cumsum(sizes) - sizes, sizes
        tables, base = [found, heads], len(found) + len(heads)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            for part in self.cuts(texts[i].as_py()):
                tables.append(self._whole([part])[0])
                n[ends[i]] += len(tables[-1])
            starts[ends[i]], base = base, base + n[ends[i]]
        before = np.concatenate([[0], np.cumsum(n)])
        return gather(np.concatenate(tables), starts, n), before[ends[1:]] - before[ends[:-1]]

    def _word_table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, a space before each. A mark behind a letter or a digit begins a new piece,
        so marks at a word's end are encoded apart and far fewer words are different."""
        stems = pc.utf8_rtrim(words, MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, LETTER_ENDS), stems, words)
        lengths = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        some = [np.flatnonzero(lengths == n) for n in np.unique(lengths[lengths > 0])]
        tails = [pc.utf8_slice_codeunits(words.take(pa.array(at)), start=-int(lengths[at[0]])) for at in some]
        tails, ended = pa.concat_arrays([pa.array([], pa.string()), *tails]).dictionary_encode(), np.concatenate([np.zeros(0, np.int64), *some])
        stems = stems.dictionary_encode()
        ids, n = self._known(stems.dictionary)
        tail_ids, tail_n = self._whole(tails.dictionary.to_pylist())
        starts, counts = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        at = stems.indices.to_numpy()
        starts[:, 0], counts[:, 0] = (np.cumsum(n) - n)[at], n[at]
        at = tails.indices.to_numpy()
        starts[ended, 1], counts[ended, 1] = len(ids) + (np.cumsum(tail_n) - tail_n)[at], tail_n[at]
        return gather(np.concatenate([ids, tail_ids]), starts.ravel(), counts.ravel()), counts.sum(axis=1)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, their number in each text) for slices of bounded bytes. A text
        above the bound is a slice of its own and is encoded in parts."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, size in enumerate([*sizes.tolist(), 0]):
            if i == len(sizes) or (total and total + size > SLICE_BYTES):
                if i > at:
                    yield at, *self._slice(texts.slice(at, i - at), total)
                    give_back()
                at, total = i, 0
            total += size

    def _slice(self, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size <= SLICE_BYTES:
            return self.encode(texts)
        parts = [self.encode(pa.array([p]))[0] for p in self.cuts(texts[0].as_py())]
        return np.concatenate(parts), np.array([sum(map(len, parts))])


def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process, for the vocabulary asked for last."""
    return kept(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
