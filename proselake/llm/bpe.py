"""Byte-pair encoding and decoding as bounded-lookahead streams.

How far ahead must one look before a token is settled? A merge (x, w) takes x away from a later
merge only if w, to the right of x, has formed by then; whether w forms depends in turn on what
stands right of w, by merges of still lower rank. So the reach of each merge is
len(w) + reach of w at that rank, one pass over the merge list in order of rank gives all of them,
and the largest is a sufficient lookahead L: text more than L symbols behind a token's end cannot
change it. The encoder keeps a window of fixed size, merges inside it, emits the tokens that end at
least L symbols before the window's end and moves on; however long a word is, memory stays constant.

Words are cut by the tokenizer's pattern. A blank between two other characters always starts a new
word, so a text is split there and the pieces are kept in a bounded cache. Short words that a batch
of texts brings up for the first time fill only a part of a window each; they are merged side by side,
one merge of each word at a time, as rows of a matrix.

Decoding is a state machine from bytes to text: ids become bytes, and the state between blocks of
ids is the incomplete UTF-8 sequence at the end.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keyed_text, table

CACHE = 300_000
#: Words of at most so many bytes are merged side by side, so many at a time.
SHORT, ROWS = 40, 4096
#: A text is taken in pieces of about so many characters.
PIECE = 1 << 15
#: Fixed by the tokenizer's format: how byte-level BPE cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeList:
    """Ranked merges over strings of symbols, with their sufficient lookahead."""

    def __init__(self, merges: Iterable[tuple[int, str, str]]):
        """merges: (rank, left, right); pairs of equal rank form the same string."""
        self.rank: dict[tuple[str, str], int] = {}
        waits: dict[str, int] = {}  # reach of a formed string through merges that start with it
        spine: dict[str, int] = {}  # reach through its right edge while it was being formed
        longest = 1
        for rank, left, right in sorted(merges):
            self.rank[left, right] = rank
            reach = max(waits.get(right, 0), spine.get(right, 0))
            whole = left + right
            spine[whole] = max(spine.get(whole, 0), reach)
            waits[left] = max(waits.get(left, 0), len(right) + reach)
            longest = max(longest, len(whole))
        self.longest = longest
        self.none = 1 << 40  # the rank of pairs that do not merge
        self.lookahead = max([0, *waits.values(), *spine.values()])
        self.window = max(256, 2 * (longest + self.lookahead))

    def merged(self, parts: list[str]) -> list[str]:
        """All merges applied to parts (which is changed), lowest rank first, leftmost first."""
        get, none = self.rank.get, self.none
        ranks = [get(p, none) for p in zip(parts, parts[1:])]  # noqa: B905  the last one has no partner
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], whole), none)
            if i < len(ranks):
                ranks[i] = get((whole, parts[i + 1]), none)
        return parts

    def stream(self, symbols: str) -> Iterator[str]:
        """Tokens of one word, emitted once stable."""
        at, n = 0, len(symbols)
        while n - at > self.window:
            end = 0
            for token in self.merged(list(symbols[at : at + self.window])):
                if end + len(token) > self.window - self.lookahead:
                    break
                end += len(token)
                yield token
            at += end
        yield from self.merged(list(symbols[at:]))


class SideBySide:
    """The merges of many short words at once, over ids of tokens."""

    def __init__(self, merges: MergeList, vocab: dict[str, int], letters: list[str]):
        known = sorted((r, vocab[a], vocab[b], vocab[a + b]) for (a, b), r in merges.rank.items())
        rank, left, right, whole = np.array(known, np.int64).reshape(-1, 4).T
        self.size = max(vocab.values(), default=0) + 1
        self.none = int(rank.max(initial=0)) + 1
        self.whole = np.zeros(self.none + 1, np.int64)
        self.whole[rank] = whole
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(rank[order], self.none)
        self.letters = np.array([vocab[c] for c in letters], np.int64)
        first = self.letters[:, None] * self.size + self.letters
        self.first = self.rank_of(first.ravel())

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)

    def merged(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all words and where each word's end; the lowest rank of a word first, leftmost first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=1)) + 1  # the last column is never part of a word
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width).astype(np.int64)
        column = np.arange(width)
        ids = self.letters[raw]
        ranks = np.full(ids.shape, self.none)  # of the pair that starts in a column
        ranks[:, :-1] = np.where(column[1:] < size[:, None], self.first[raw[:, :-1] * 256 + raw[:, 1:]], self.none)
        out, left = ids.copy(), np.arange(len(words))
        while True:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(ranks)), at]
            going = low != self.none
            if not going.all():
                out[left[~going]] = ids[~going]
                ids, ranks, at, low, left = ids[going], ranks[going], at[going], low[going], left[going]
                if not len(ids):
                    return out[column < size[:, None]].tolist(), np.cumsum(size).tolist()
            size[left] -= 1
            behind = column > at[:, None]
            ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            row = np.arange(len(ids))
            new = ids[row, at] = self.whole[low]
            after = self.rank_of(new * self.size + ids[row, at + 1])
            ranks[row, at] = np.where(at + 1 < size[left], after, self.none)
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.rank_of(ids[inner, at[inner] - 1] * self.size + new[inner])


class _Unsplittable(Exception):
    """A blank that does not stand between two other characters."""


class _Pieces(dict):
    """Ids of the text after a blank, up to the next one."""

    def __init__(self, coder: ByteBpe):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsplittable
        if len(self) >= CACHE:
            self.clear()
        found = self.coder.pattern.findall(" " + piece)
        ids = self.coder.word(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self.coder.word, found)))
        if len(piece) < 64:
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file (.json)."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = MergeList((i, a, b) for i, (a, b) in enumerate(pairs))
        letters = byte_letters()
        self.to_letters = {i: c for i, c in enumerate(letters)}
        byte_of = {c: i for i, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.special_pattern = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(special, key=len, reverse=True))) if special else None
        self.bytes_of: list[bytes] = [b""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.whole = frozenset(t for t in self.vocab if len(t) <= 8 and t not in special and self.merges.merged(list(t)) == [t])
        self.pieces = _Pieces(self)
        self.side_by_side = SideBySide(self.merges, self.vocab, letters)
        self.shared = list(range(len(self.bytes_of)))  # one object for each id

    def learn(self, texts: Iterable[str]) -> None:
        """Put the short new words and pieces of texts, none longer than PIECE, into the caches."""
        new = {p for t in texts for p in t.split(" ")} - self.pieces.keys()
        new = [p for p in new if 0 < len(p) < 64 and not p[0].isspace() and not p[-1].isspace()]
        found = self.pattern.findall(" " + " ".join(new)) if new else []
        words = set(found)
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        if len(self.pieces) + len(new) > CACHE:
            self.pieces.clear()
        words = {w: b for w in words - self.cache.keys() if len(b := w.encode()) <= SHORT}
        names = list(words)
        for lo in range(0, len(names), ROWS):
            some = names[lo : lo + ROWS]
            ids, ends = self.side_by_side.merged([words[w] for w in some])
            ids = tuple(map(self.shared.__getitem__, ids))
            self.cache.update(zip(some, (ids[a:b] for a, b in pairwise([0, *ends])), strict=True))
        starts = [i for i, w in enumerate(found) if w[0] == " "]  # a piece has no blank in it and one before it
        for piece, a, b in zip(new, starts, [*starts[1:], len(found)], strict=True):
            self.pieces[piece] = self.word(found[a]) if b - a == 1 else tuple(chain.from_iterable(map(self.word, found[a:b])))

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.cache.get(word)
        if ids is None:
            symbols = word.encode().decode("latin-1").translate(self.to_letters)
            if len(symbols) > self.merges.window:
                tokens = self.merges.stream(symbols)
            else:  # the whole word is in the window
                tokens = [symbols] if symbols in self.whole else self.merges.merged(list(symbols))
            ids = tuple(map(self.vocab.__getitem__, tokens))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(word) < 64:
                self.cache[word] = ids
        return ids

    def words(self, text: str) -> Iterator[int]:
        for m in self.pattern.finditer(text):
            yield from self.word(m[0])

    def split(self, text: str) -> Iterable[int]:
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Unsplittable
            return [*self.words(first), *chain.from_iterable(map(self.pieces.__getitem__, rest))]
        except _Unsplittable:
            return self.words(text)

    def plain(self, text: str) -> Iterator[Iterable[int]]:
        """The ids of each piece; a piece ends before a blank between two other characters, where a new word starts."""
        at = 0
        while len(text) - at > PIECE:
            cut = text.rfind(" ", at + 1, at + PIECE)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:  # one long word, or blanks only: word by word
                break
            yield self.split(text[at:cut])
            at = cut
        yield self.split(text[at:]) if len(text) - at <= PIECE else self.words(text[at:])

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text; null is empty. Strings of special tokens in it become these tokens."""
        out = array("i")
        if not text:
            return np.zeros(0, np.int32)
        if not any(t in text for t in self.special):
            for ids in self.plain(text):
                out.extend(ids)
            return np.frombuffer(out, np.int32)
        at = 0
        for m in self.special_pattern.finditer(text):
            for ids in self.plain(text[at : m.start()]):
                out.extend(ids)
            out.append(self.special[m[0]])
            at = m.end()
        for ids in self.plain(text[at:]):
            out.extend(ids)
        return np.frombuffer(out, np.int32)

    def forget(self) -> None:
        """Empty the larger cache, so that an idle worker holds little but the tables of the tokenizer; words stay."""
        self.pieces.clear()

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        """The text of ids, read block by block; bytes that are not UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        out = [state.decode(b"".join(map(get, ids[i : i + block].tolist()))) for i in range(0, len(ids), block)]
        return "".join([*out, state.decode(b"", final=True)])


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One coder per process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; null and empty texts have no ids.

    With `decoded`, also the text that the ids decode to, from the same pass. docs: doc_id long, text
    string; other columns are ignored, and every row stays, whatever its id and however often it occurs.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coder.learn(t.as_py() for t in part["text"] if t.is_valid and t.as_buffer().size <= PIECE)
                ids = [coder.encode(t.as_py()) for t in part["text"]]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                cols = {"doc_id": part["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))}
                if decoded:
                    cols["decoded"] = pa.array(map(coder.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])
        coder.forget()

    return keyed_text(docs).mapInArrow(f, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(coded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """`coded` with the text of its column ids instead of that column; null ids are an empty text."""
    rest = [c for c in coded.columns if c != "ids"]
    fields = ", ".join(f"`{c}` {t}" for c, t in coded.dtypes if c != "ids")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [coder.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in part["ids"]]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in rest], pa.array(texts, pa.string())], names=[*rest, column])

    return coded.mapInArrow(f, f"{fields}, {column} string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids_digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
