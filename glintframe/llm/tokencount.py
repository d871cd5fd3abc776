"""Token counts by a compiled finite-state transducer.

A byte-pair tokenizer with scored pieces is compiled into a deterministic transducer over characters.
It rests on one fact: merging by score gives the token sequence t1..tn to a string exactly if every
neighbouring pair gives itself (t_i t_{i+1} stays t_i t_{i+1} when merged alone). So the last token of a
prefix, and the number of its tokens, follow from the last tokens of shorter prefixes, and only
positions from which some piece could still reach the next character matter. A state is the list of
those positions: (piece-trie node between there and here, last token there, tokens since). A transition
is annotated with the change of the token count: 1 for a new token, 0 or less where the new character
merges what stood before. States are interned as texts reach them; the table is dense, state x symbol.

Characters no piece contains emit their UTF-8 bytes and reset the transducer, as does a word mark after
another character, since no piece holds one inside (checked when compiling).

Texts are cut into chunks of equal length, all of which run side by side, one table step for all of them
at a time. A chunk's state map takes the state before it to the state after it and the tokens emitted
between; it is built for the states met. The first state to try comes from running up to the chunk from
the last reset before it, which gives the true one, or, in a text without resets, from `AHEAD`
characters back, which mostly does. Where the map before ends in a state that a chunk's map lacks, the
chunk runs again from that one, again all such chunks side by side. The maps then compose by a parallel
prefix scan (pointer jumping, log of the number of chunks in rounds) into each text's count. So a long
text without a blank is spread like any other.

Scale: one pass, no shuffle. A worker's table is bounded by `TABLE` entries: it is dropped and regrown
beyond that, and a batch that alone overflows it is halved, down to one text, which is then counted in
sections, the state carried from one table to the next.

Edge cases: null and empty texts have 0 tokens and 0 bytes; special strings in a text are ordinary
text; texts of any length are counted whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 512  # characters
AHEAD = 128  # characters before a chunk from which its first state is sought
ALL_ROUNDS = 4  # rounds that complete every map; later ones only those on a text's path
BATCH = 2_000_000  # characters that run together
TABLE = 34_000_000  # entries of a worker's transition table
MARK = "▁"
BREAK = -1  # the token before a position where nothing can merge
UNSEEN = -1


class Overflow(Exception):
    """The transition table would grow beyond its bound."""


class Transducer:
    """Compiled from a sentencepiece byte-pair model with byte fallback and identity normalisation."""

    def __init__(self, path: str, table: int = TABLE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bound = table
        self.pieces = {}
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.pieces[sp.id_to_piece(i)] = i
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        self.text = {i: p for p, i in self.pieces.items()}
        for p in self.pieces:
            if any(a != MARK and b == MARK for a, b in zip(p, p[1:])):
                raise ValueError("a piece has a word mark after another character")
            if any(c not in self.pieces for c in p):
                raise ValueError("a piece has a character that is no piece")
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [BREAK]
        for p, i in self.pieces.items():
            node = 0
            for c in p:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(BREAK)
                node = self.children[node][c]
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget states and symbols. Symbols 1-4: characters of that many bytes outside all pieces."""
        self.symbol = np.zeros(0x110000, dtype=np.uint16)
        self.chars: list[str] = ["", "", "", "", ""]
        self.width = 128
        self.next = np.full((1024, self.width), UNSEEN, dtype=np.int32)
        self.emit = np.zeros((1024, self.width), dtype=np.int8)
        self.states: list[tuple] = []
        self.interned: dict[tuple, int] = {}
        self.start = self.intern(((0, BREAK, 0),))
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()

    # -- compiling -------------------------------------------------------------------------------

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the text of tokens a and b by score gives exactly a, b."""
        if a == BREAK:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.apart(self.text[a], self.text[b])
        return known

    def apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses from a to b while their joined text is merged, best score first."""
        score = self.score
        if a + b in score:
            return False
        parts, border = [*a, *b], len(a)  # parts[border] is the first part of b
        scores = [score.get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return len(parts) == 2
            if at == border - 1:
                return False
            if at < border:
                border -= 1
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1])

    def intern(self, state: tuple) -> int:
        k = self.interned.get(state)
        if k is None:
            k = self.interned[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.next):
                self.resize(2 * len(self.next), self.width)
        return k

    def resize(self, rows: int, width: int) -> None:
        if rows * width > self.bound:
            raise Overflow
        bigger = np.full((rows, width), UNSEEN, dtype=np.int32)
        bigger[:self.next.shape[0], :self.width] = self.next
        more = np.zeros((rows, width), dtype=np.int8)
        more[:self.emit.shape[0], :self.width] = self.emit
        self.next, self.emit, self.width = bigger, more, width

    def step(self, k: int, symbol: int) -> None:
        """Work out one transition: fill next and emit at (k, symbol)."""
        if symbol <= 4:
            self.next[k, symbol], self.emit[k, symbol] = self.start, symbol
            return
        c = self.chars[symbol]
        old, last, change, open_ = self.states[k], None, 0, []
        for node, token, since in old:
            child = self.children[node].get(c)
            if child is None:
                continue
            if last is None and self.token[child] != BREAK and self.stays(token, self.token[child]):
                last, change = self.token[child], 1 - since
            if self.children[child]:
                open_.append((child, token, since))
        if c == MARK and not self.text.get(old[0][1], "").endswith(MARK):
            open_ = [(child, BREAK, since) for child, _, since in open_]
        new = ((0, last, 0), *((child, token, since + change) for child, token, since in open_))
        to = self.intern(new)
        self.next[k, symbol], self.emit[k, symbol] = to, change

    # -- running ---------------------------------------------------------------------------------

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = self.symbol[codes]
        if not out.all():
            for code in np.unique(codes[out == 0]).tolist():
                c = chr(code)
                if c in self.pieces:
                    if len(self.chars) >= self.width:
                        self.resize(len(self.next), 2 * self.width)
                    self.symbol[code] = len(self.chars)
                    self.chars.append(c)
                else:
                    self.symbol[code] = len(c.encode("utf-8", "surrogatepass"))
            out = self.symbol[codes]
        return out

    def run(self, symbols: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after symbols[first:first+length] of each lane, and tokens emitted, all lanes side by side."""
        order = np.argsort(-length, kind="stable")
        at, size = first[order].astype(np.int64), length[order]
        state = state[order].astype(np.int64)
        count = np.zeros(len(at), dtype=np.int64)
        active = len(at) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
        for k, m in enumerate(active.tolist()):
            c = symbols[at[:m] + k]
            where = state[:m] * self.width + c
            to = self.next.ravel()[where]
            if to.min() < 0:
                for key in np.unique(where[to < 0]).tolist():
                    if self.next.ravel()[key] == UNSEEN:
                        width = self.width
                        self.step(key // width, key % width)
                to = self.next.ravel()[where]
            count[:m] += self.emit.ravel()[where]
            state[:m] = to
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if not texts:
            return np.zeros(0, dtype=np.int64)
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        for _ in range(2):  # once more with an empty table
            try:
                return self.scan(marked)[0]
            except Overflow:
                self.clear()
        if len(texts) == 1:
            return np.array([self.sections(marked[0])], dtype=np.int64)
        half = len(texts) // 2
        return np.concatenate([self.count(texts[:half]), self.count(texts[half:])])

    def sections(self, marked: str) -> int:
        """The tokens of one text with more states than the table holds: the table is cleared between its sections."""
        state, total, at, size = self.states[self.start], 0, 0, -(-len(marked) // 2)
        while at < len(marked):
            self.clear()
            try:
                tokens, ends = self.scan([marked[at:at + size]], state)
            except Overflow:
                if size <= CHUNK:
                    raise
                size = max(CHUNK, -(-size // 2))
                continue
            total, state, at = total + int(tokens[0]), self.states[ends[0]], at + size
        return total

    def scan(self, marked: list[str], entry: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and the state after it; entry: the state before them, that of a new text unless given."""
        start = self.start if entry is None else self.intern(entry)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.symbols(codes)
        sizes = np.array([len(t) for t in marked], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        counts, ends = np.zeros(len(marked), dtype=np.int64), np.full(len(marked), start, dtype=np.int64)
        if not len(symbols):
            return counts, ends
        # Where the state before does not matter: a mark after another symbol, after a symbol of no
        # piece, and the beginning of a text.
        mark = int(self.symbol[ord(MARK)])
        reset = np.zeros(len(symbols), dtype=bool)
        reset[1:] = ((symbols[1:] == mark) & (symbols[:-1] != mark)) | (symbols[:-1] <= 4)
        reset[begins[sizes > 0]] = entry is None
        chunks = -(-sizes // CHUNK)
        heads = np.cumsum(chunks) - chunks
        nth = np.arange(int(chunks.sum())) - np.repeat(heads, chunks)
        first = np.repeat(begins, chunks) + CHUNK * nth
        length = np.minimum(CHUNK, np.repeat(begins + sizes, chunks) - first)
        last = nth == np.repeat(chunks, chunks) - 1
        # The first state to try of each chunk.
        latest = np.maximum.accumulate(np.where(reset, np.arange(len(symbols)), -1))
        inner = np.flatnonzero(nth > 0)
        back = np.minimum(first[inner] - latest[first[inner] - 1], np.minimum(AHEAD, first[inner]))
        state = np.full(len(first), start, dtype=np.int64)
        state[inner] = self.run(symbols, first[inner] - back, back, np.full(len(inner), self.start))[0]
        # Entries of the state maps: (chunk, state before) -> state after, tokens.
        place: dict[tuple[int, int], int] = {}
        chunk_of, after, tokens = (np.zeros(0, dtype=np.int64) for _ in range(3))
        todo = list(zip(range(len(first)), state.tolist()))
        turn, own, node, total = 0, None, None, None
        while todo:
            place.update(zip(todo, range(len(place), len(place) + len(todo))))
            chunk, before = np.array(todo, dtype=np.int64).T
            to, n = self.run(symbols, first[chunk], length[chunk], before)
            chunk_of, after, tokens = np.append(chunk_of, chunk), np.append(after, to), np.append(tokens, n)
            following = np.array([-1 if end else place.get((c + 1, s), -2) for c, s, end in zip(chunk_of.tolist(), after.tolist(), last[chunk_of].tolist())])
            node, total = self.composed(following, tokens)
            turn += 1
            # Maps that lack a state: all, or those where a text's composition stops.
            own = np.array([place[h, start] for h in heads[chunks > 0].tolist()], dtype=np.int64)
            stops = np.arange(len(following)) if turn < ALL_ROUNDS else np.unique(node[own])
            todo = sorted({(int(chunk_of[i]) + 1, int(after[i])) for i in stops[following[stops] == -2]})
        counts[chunks > 0], ends[chunks > 0] = total[own], after[node[own]]
        return counts, ends

    @staticmethod
    def composed(following: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each map entry, the last entry that composition reaches from it, and the tokens up to its end.

        following: the entry that goes on from there, negative where there is none. A prefix scan: each round
        doubles the chunks that an entry's composition covers.
        """
        ends = following < 0
        jump = np.where(ends, np.arange(len(following)), following)
        before = np.where(ends, 0, tokens)  # tokens up to the entry that `jump` names
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump, before + tokens[jump]
            before, jump = before + before[jump], further


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _count_batches(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ends, size = [0], 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size > BATCH or i == len(texts) - 1:
                    ends.append(i + 1)
                    size = 0
            n = np.concatenate([compiled(path).count(texts[a:b]) for a, b in zip(ends, ends[1:])] or [np.zeros(0, dtype=np.int64)])
            size_of = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size_of, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `docs`."""
    if model is None:
        import public_tokenizers
        model = public_tokenizers.path(MODEL)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_count_batches(model, limit), SCHEMA)


def op3_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
