"""BPE encoding and decoding by speculation and verification.

A word's tokens are first proposed by a greedy longest match over the vocabulary.  A sequence of
tokens is what BPE itself would have produced exactly when every adjacent pair is compatible: at no
time in the pair's merge history would a merge across their border have come first.  That test runs
over all adjacent pairs of a batch in numpy.  Only the words with an incompatible pair go through
exact merging, itself done for all such words at once.

A batch of texts is cut at white space, equal chunks are made one, and only chunks not seen before are
normalised, cut into pieces and encoded; the ids of the texts are then gathered from those of their
chunks.  Decoding starts from ids alone: the names of all tokens of a batch are gathered into one
buffer, in which each text is a range.

Edge cases: a null or empty text has no token and decodes to the empty string; a text without any
piece that the pre-tokenizer keeps likewise.  Rows are independent, so repeated rows give repeated
results, and columns besides id and text are passed through untouched when asked for.  A word of
any length is encoded whole: words over ``LONG_WORD`` symbols use a heap, O(n log n).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import frugal, slices, small_batches

NONE = np.int64(1 << 40)
LONG_WORD = 400
CACHE_LETTERS = 16_000_000
LENGTH_BITS = 20  # of a token's length, beside its id
BATCH_BYTES = 4_000_000

# Fixed values of the file format: Unicode White_Space, and the bytes that byte-level BPE shows as themselves.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHOWN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

BREAK = "\n"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte; bytes that aren't shown get characters from U+0100 on."""
    hidden = (b for b in range(256) if b not in SHOWN)
    return {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Seen(dict):
    """Strings numbered in the order they are first asked for, with the ids that each stands for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.letters = 0
        self.flat, self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def fresh(self) -> list[str]:
        """Strings that have no ids yet; ``extend`` gives them."""
        out, self.new = self.new, []
        self.letters += sum(map(len, out)) + 10 * len(out)
        return out

    def extend(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(size) - size]
        self.flat, self.size = np.r_[self.flat, flat], np.r_[self.size, size]

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the strings at these places, in a row."""
        size = self.size[places]
        skip = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.first[places] - skip, size)]


class SeenChunks(Seen):
    """The same of strings in Arrow: those known are looked up there, and only new ones become Python's."""

    def __init__(self):
        super().__init__()
        self.known = pa.array([], pa.string())

    def places(self, words: pa.Array) -> np.ndarray:
        """words are distinct."""
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(at))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out[out < 0] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.new = fresh.to_pylist()
        return out


def in_order(tok: list[np.ndarray], word: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several lists by their word; those of one word are in one list, in order."""
    if not tok:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, of = np.concatenate(tok), np.concatenate(word)
    order = np.argsort(of, kind="stable")
    return one[order], of[order]


class WordBPE:
    """A tokenizer file of the ``tokenizers`` library: word-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        size = max(self.vocab.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in model["merges"]:
            made = self.vocab[a + b]
            self.left[made], self.right[made] = self.vocab[a], self.vocab[b]
            self.pair[self.vocab[a], self.vocab[b]] = made
        made = list(self.pair.values())
        if made != sorted(made) or any(max(k) >= v for k, v in self.pair.items() if self.left[max(k)] >= 0):
            raise ValueError(f"{path}: token ids must follow the order of the merges")
        self.size = size
        self.place_pairs(np.array([a * size + b for a, b in self.pair], np.int64), np.array(made, np.int64))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.pieces = regex.compile(f"{pattern}|{BREAK}").findall
        if self.pieces("ab") != ["ab"]:
            raise ValueError(f"{path}: letters that follow each other must be one piece")
        alphabet = byte_alphabet()
        self.first, self.last = (np.full(max(map(ord, alphabet.values())) + 1, -1, np.int64) for _ in range(2))
        for c in alphabet.values():
            self.first[ord(c)], self.last[ord(c)] = self.vocab[c], self.vocab[c + self.suffix]
        self.by_byte = str.maketrans({chr(b): c for b, c in alphabet.items()})
        # A token that BPE never makes of its own letters isn't proposed.
        names = [t for t in self.vocab if t not in self.special]
        bare = [t.removesuffix(self.suffix) for t in names]
        tok, word = self.letters(bare, np.array([len(b) < len(t) for b, t in zip(bare, names, strict=True)]))
        tok, word = self.merge(tok, word)
        alone = np.bincount(word, minlength=len(names)) == 1
        made_of = np.full(len(names), -1, np.int64)
        made_of[word] = tok
        self.longest = ahocorasick.Automaton()
        for k, t in enumerate(names):
            if alone[k] and made_of[k] == self.vocab[t]:
                key = bare[k] + BREAK if len(bare[k]) < len(t) else t
                self.longest.add_word(key, self.vocab[t] << LENGTH_BITS | len(key))
        self.longest.make_automaton()
        # Names as decoding puts them: each with a space after it, then each as the last of a text.
        known = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        names = [known.get(i, "") for i in range(max(known) + 1)]
        self.names = pa.array([f"{t} " for t in names] + names, pa.string())
        self.forget()

    def forget(self) -> None:
        """Drop the chunks and pieces seen: a worker that lives on holds only the tokenizer."""
        self.chunks, self.parts = SeenChunks(), Seen()
        self.parts.places([BREAK, *self.special])
        self.parts.fresh()
        self.parts.extend(np.array([*self.special.values()], np.int64), np.array([0] + [1] * len(self.special), np.int64))

    def letters(self, words: list[str], ended: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all words in a row, in the byte-level alphabet, and the word of each; the last one of a word that has ended is of its own kind."""
        at = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        size = np.array(list(map(len, words)), np.int64)
        tok, last = self.first[at], np.cumsum(size) - 1
        if ended is not None:
            last = last[ended]
        tok[last] = self.last[at[last]]
        return tok, np.repeat(np.arange(len(words)), size)

    def place_pairs(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A hash table of the merges, a pair in the first free slot from its own on."""
        self.bits = int(16 * len(keys)).bit_length()
        self.slot_key, self.slot_made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        at = self.slot_of(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[free]  # of several for one slot the last stays
            mine = self.slot_key[at] == keys
            self.slot_made[at[mine]] = made[mine]
            keys, made, at = keys[~mine], made[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, NONE where there is no such merge."""
        key = x * self.size + y
        at = self.slot_of(key)
        there = self.slot_key[at]
        out = np.where(there == key, self.slot_made[at], NONE)
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[at[on]]
            hit = there == key[on]
            out[on[hit]] = self.slot_made[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between tokens x and y standing.

        Both tokens' merges are undone, latest first.  What then meets at the border could have merged
        there; it did not if one of the two had been used up by an earlier merge within its own token.
        Ids follow merge order, so they serve as times; of equal merges the left one came first.
        """
        fine = np.ones(len(x), bool)
        at = np.arange(len(x))
        x, y = x.copy(), y.copy()
        used_x, used_y = np.full(len(x), NONE), np.full(len(x), NONE)
        while len(at):
            across = self.look_up(x, y)
            clash = (across < used_x) & (across <= used_y)
            fine[at[clash]] = False
            undo_x = (x > y) & (self.left[x] >= 0)
            undo_y = ~undo_x & (self.left[y] >= 0)
            used_x, used_y = np.where(undo_x, x, used_x), np.where(undo_y, y, used_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            on = ~clash & (undo_x | undo_y)
            at, x, y, used_x, used_y = at[on], x[on], y[on], used_x[on], used_y[on]
        return fine

    def merge(self, tok: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of words given as letters and the word of each: in each round every word does its earliest merge."""
        done_tok, done_word = [], []
        size = np.bincount(word)
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            low, high = np.searchsorted(word, [w, w + 1])
            got = self.merge_long(tok[low:high].tolist())
            done_tok.append(np.array(got, np.int64))
            done_word.append(np.full(len(got), w))
        short = size[word] <= LONG_WORD
        tok, word = tok[short], word[short]
        while len(tok):
            new = np.full(len(tok), NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            new[inside] = self.look_up(tok[inside], tok[inside + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(new, starts), np.diff(np.r_[starts, len(tok)]))
            ended = least == NONE
            done_tok.append(tok[ended])
            done_word.append(word[ended])
            # Of overlapping equal merges ("aaa") every second one from the left happens.
            pos = np.flatnonzero((new == least) & ~ended)
            run = np.flatnonzero(np.r_[True, np.diff(pos) != 1]) if len(pos) else pos
            offset = np.arange(len(pos)) - np.repeat(run, np.diff(np.r_[run, len(pos)]))
            pos = pos[offset % 2 == 0]
            tok[pos] = new[pos]
            keep = ~ended
            keep[pos + 1] = False
            tok, word = tok[keep], word[keep]
        return in_order(done_tok, done_word)

    def merge_long(self, tok: list[int]) -> list[int]:
        tok, after = list(tok), list(range(1, len(tok) + 1))
        before = list(range(-1, len(tok) - 1))
        heap = [(self.pair[p], i, *p) for i, p in enumerate(zip(tok, tok[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(tok) or tok[i] != a or tok[j] != b:
                continue
            tok[i], tok[j], after[i] = made, -1, after[j]
            if after[j] < len(tok):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(tok) and (p := (tok[k], tok[after[k]])) in self.pair:
                    heapq.heappush(heap, (self.pair[p], k, *p))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words in the byte-level alphabet, in a row, and how many each has: propose, verify, and merge what fails."""
        joined = BREAK.join([*words, ""])
        ends = np.cumsum(list(map(len, words))) + np.arange(1, len(words) + 1)
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(joined)), np.int64).reshape(-1, 2)
        ids, size = found[:, 1] >> LENGTH_BITS, found[:, 1] & ((1 << LENGTH_BITS) - 1)
        word = np.searchsorted(ends, found[:, 0] + 1, "left")
        good = np.bincount(word, size, len(words)) == np.diff(np.r_[0, ends])  # covered to the end
        inside = np.flatnonzero(word[1:] == word[:-1])
        good[word[inside[~self.compatible(ids[inside], ids[inside + 1])]]] = False
        failed = np.flatnonzero(~good)
        fine = good[word]
        tok, of = self.merge(*self.letters([words[i] for i in failed.tolist()]))
        out, word = in_order([ids[fine], tok], [word[fine], failed[of]])
        return out, np.bincount(word, minlength=len(words))

    def pieces_of(self, chunks: list[str]) -> list[str]:
        """Pieces of each chunk in order, with BREAK after each chunk; special tokens are pieces."""
        out = []
        for c in chunks:
            for k, part in enumerate(self.at_special.split(c)):
                out += [part] if k % 2 else self.pieces(self.normal(part))
            out.append(BREAK)
        return out

    @staticmethod
    def normal(text: str) -> str:
        # Runs of white space need not be made one: no piece has any.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def by_bytes(self, words: list[str]) -> list[str]:
        return BREAK.join(words).encode().decode("latin-1").translate(self.by_byte).split(self.by_byte[ord(BREAK)])

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that weren't seen before, by their pieces that weren't.  A chunk of letters alone is one piece; others are cut."""
        joined = BREAK.join(chunks)
        if any(s in joined for s in self.special):
            plain, rest = np.empty(0, np.int64), np.arange(len(chunks))
            whole, cut = [], self.pieces_of(chunks)
        else:
            normal = self.normal(joined).split(BREAK)
            letters = np.fromiter(map(str.isalpha, normal), bool, len(normal))
            plain, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
            whole = list(compress(normal, letters.tolist()))
            cut = self.pieces(BREAK.join([*map(normal.__getitem__, rest.tolist()), ""])) if len(rest) else []
        part_whole, part_cut = self.parts.places(whole), self.parts.places(cut)
        if fresh := self.parts.fresh():
            self.parts.extend(*self.encode_words(self.by_bytes(fresh)))
        ends = part_cut == 0
        of_cut = rest[(np.cumsum(ends) - ends)[~ends]] if len(rest) else rest
        part, chunk = np.r_[part_whole, part_cut[~ends]], np.r_[plain, of_cut]
        order = np.argsort(chunk, kind="stable")
        size = np.bincount(chunk, self.parts.size[part], len(chunks)).astype(np.int64)
        self.chunks.extend(self.parts.gather(part[order]), size)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has.

        Texts are cut at ASCII white space, and equal chunks found, in Arrow; white space of other kinds stays within chunks, and no piece has any.
        """
        if self.chunks.letters + self.parts.letters > CACHE_LETTERS:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        chunk = self.chunks.places(coded.dictionary)[coded.indices.to_numpy()]
        if fresh := self.chunks.fresh():
            self.learn(fresh)
        text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        return self.chunks.gather(chunk), np.bincount(text_of, self.chunks.size[chunk], len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts that ids in a row stand for, special tokens included; counts says how many ids each text has."""
        last = np.cumsum(counts)
        at = ids.astype(np.int64)
        at[last[counts > 0] - 1] += len(self.names) // 2
        shown = self.names.take(pa.array(at))
        offsets = np.frombuffer(shown.buffers()[1], np.int32, len(at) + 1, shown.offset * 4) if len(at) else np.zeros(1, np.int32)
        ends = np.ascontiguousarray(offsets[np.r_[0, last]])
        return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(ends), shown.buffers()[2] or pa.py_buffer(b"")])


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    ends = (4 * np.r_[0, np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4").tobytes())])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids are packed little-endian unsigned 32-bit integers.

    The tokenizer's file must be on every executor under the same path, as a library's file is.
    """
    id_type = dict(docs.dtypes)[id_col]
    small_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        try:
            for batch in batches:
                for at, end in slices(batch.column(1), BATCH_BYTES):
                    ids, counts = bpe.encode(batch.column(1).slice(at, end - at))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), packed(ids, counts), bpe.decode(ids, counts)], ["id", "ids", "decoded"])
        finally:
            # Half a second to build, 100 MB to keep: a worker that waits for another stage's tasks keeps none.
            del bpe
            tokenizer.cache_clear()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of packed ids; null ids decode to the empty string."""
    id_type = dict(coded.dtypes)[id_col]
    small_batches(coded.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            listed = [b or b"" for b in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(listed), "<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.decode(ids, np.array([len(b) // 4 for b in listed], np.int64))], ["id", "decoded"])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, decoded string").withColumnRenamed("id", id_col)
