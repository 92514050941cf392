"""Token counts by a compiled finite-state tokenizer.

The tokenizer is a BPE model over characters. Two facts make it a deterministic transducer. A token
sequence is the encoding of its text exactly if each pair of neighbours is the encoding of the two
together, and the encoding of a text cut at a token's end is its first tokens. So the encoding of a
prefix that is one character longer ends in the one token that suits the last token of the shorter
prefix before it, and its length is that prefix's length and one more.

A state holds what later tokens may need: for each place from which the text read so far is the start
of some piece, that text, the last token before the place and the number of tokens there, counted
from the end. Pieces have a bounded length, so there are finitely many states. Transitions are
annotated with the change in the number of tokens; states and transitions are compiled when first
met, into a table that is dropped when it outgrows its bound. All text runs through this table.

Pieces hold blanks only at their start, so a blank after another character forgets all that was read.
A chunk of text is therefore a map (head, count, tail): only the part before the first such blank
depends on the state at the start, only the part from the last one on matters for what follows. Maps
compose associatively; long texts are cut into chunks that run in different tasks, and the maps of a
text are composed in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keyed_text, table
from .bpe import MergeList

#: Texts above so many characters are cut into chunks of so many that run in different tasks.
LONG, CHUNK = 1 << 16, 1 << 15
#: Bounds of the tables of states and of pairs of tokens.
STATES, PAIRS = 250_000, 300_000
_BOUNDARY = regex.compile(r"(?<=[^ ]) ")


class State(dict):
    """Character -> (next state, change in the number of tokens)."""

    __slots__ = ("blank", "open", "machine")

    def __init__(self, machine: Transducer, blank: bool, open_: tuple[tuple[str, str | None, int], ...]):
        """open_: (text from the place on, last token before it or None at a segment's start, tokens there less tokens now)."""
        super().__init__()
        self.machine, self.blank, self.open = machine, blank, open_

    def __missing__(self, char: str) -> tuple[State, int]:
        self[char] = step = self.machine.compile(self, char)
        return step


@dataclass
class ChunkMap:
    """parts: the open head and, if the chunk holds a boundary, the open tail; count: what lies between."""

    parts: list[str]
    count: int


class Transducer:
    """Counts the tokens of a sentencepiece BPE model (.model)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in ids}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("pieces with a blank behind another character are not supported")
        self.pieces = set(pieces)
        self.starts = {p[:i] for p in pieces for i in range(1, len(p))}
        scores = sorted(set(pieces.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}

        def merges():
            for p, s in pieces.items():
                for i in range(1, len(p)):
                    a, b = p[:i], p[i:]
                    if (len(a) == 1 or a in pieces) and (len(b) == 1 or b in pieces):
                        yield rank[s], a, b

        self.merges = MergeList(merges())
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.start = State(self, True, (("", None, 0),))

    def size(self, token: str) -> int:
        """A character without a piece of its own becomes its bytes."""
        return 1 if token in self.pieces else len(token.encode())

    def suits(self, before: str | None, token: str) -> bool:
        """Whether the token may follow: the encoding of both together is the two of them."""
        known = self.pairs.get((before, token))
        if known is None:
            known = self.merges.merged(list((before or "") + token)) == ([token] if before is None else [before, token])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[before, token] = known
        return known

    def compile(self, state: State, char: str) -> tuple[State, int]:
        """The transition of a state by a character."""
        fresh = char == " " and not state.blank
        places = (("", None, 0),) if fresh else state.open
        last, change = next((text + char, n + self.size(text + char)) for text, before, n in places if (not text or text + char in self.pieces) and self.suits(before, text + char))
        open_ = tuple((text + char, before, n - change) for text, before, n in places if text + char in self.starts) + (("", last, 0),)
        key = char == " ", open_
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= STATES:
                self.states.clear()
                self.start.clear()
            to = self.states[key] = State(self, *key)
        return to, change

    def run(self, text: str) -> int:
        """Tokens of a text that starts a segment."""
        state, total = self.start, 0
        for char in text:
            state, n = state[char]
            total += n
        return total

    def chunk(self, text: str) -> ChunkMap:
        first = _BOUNDARY.search(text)
        if first is None:
            return ChunkMap([text], 0)
        last = text.rindex(" ")
        while last > first.start() and text[last - 1] == " ":
            last = text.rindex(" ", 0, last)
        return ChunkMap([text[: first.start()], text[last:]], self.run(text[first.start() : last]))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        left, right = a.parts, b.parts
        if left[-1] and left[-1][-1] != " " and right[0][:1] == " ":
            parts = left + right
        else:
            parts = left[:-1] + [left[-1] + right[0]] + right[1:]
        count = a.count + b.count + sum(map(self.run, parts[1:-1]))
        return ChunkMap(parts if len(parts) == 1 else [parts[0], parts[-1]], count)

    def total(self, maps: list[ChunkMap]) -> int:
        """Compose the maps of a text in a tree; its tokens."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].count + sum(map(self.run, maps[0].parts))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        return self.run(opened(text)) if text else 0


def opened(text: str) -> str:
    """The text as the model sees it: a blank before it, and its sign for a blank is one."""
    return " " + text.replace("▁", " ")


_loaded: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text.

    Null and empty texts have no bytes and no tokens. docs: doc_id long, text string; other columns
    are ignored, and every row stays, whatever its id. Texts of more than `long` characters run in
    chunks of `chunk` that are exchanged by row; the result does not depend on either.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            n = [machine.count(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            maps = [machine.chunk(opened(t) if i == 0 else t.replace("▁", " ")) for i, t in zip(batch["i"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "doc_id", "n_bytes", "i")), pa.array([m.parts for m in maps], pa.list_(pa.string())), pa.array([m.count for m in maps], pa.int64())], names=["row", "doc_id", "n_bytes", "i", "parts", "count"])

    def join(table_: pa.Table) -> pa.Table:
        rows = sorted(table_.to_pylist(), key=lambda r: r["i"])
        n = load(path).total([ChunkMap(r["parts"], r["count"]) for r in rows])
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "n_bytes": pa.array([rows[0]["n_bytes"]], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    out = "doc_id long, n_bytes long, n_tokens long"
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    docs = keyed_text(docs).select("doc_id", size, "text")
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(whole, out)
    chunks = docs.withColumn("row", F.monotonically_increasing_id()).filter(is_long)
    chunks = chunks.select("row", "doc_id", "n_bytes", "text", F.explode(F.sequence(F.lit(0), F.expr(f"int((length(text) - 1) div {chunk})"))).alias("i"))
    chunks = chunks.withColumn("text", F.substr("text", F.col("i") * chunk + 1, F.lit(chunk)))
    counted = short.unionByName(chunks.repartition("row", "i").mapInArrow(cut, "row long, doc_id long, n_bytes long, i int, parts array<string>, count long").groupBy("row").applyInArrow(join, out))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
