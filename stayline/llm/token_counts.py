"""Token counts from a deterministic transducer compiled out of a byte-level BPE file.

The transducer reads characters. Its state is the pre-tokenizer's mode and the state of a BPE
automaton over the bytes of the open pre-token; a transition is annotated with the change it
makes to the number of tokens emitted if the text ended there, so a text's count is the sum
along its path.

BPE automaton: the encoding of a prefix ends in exactly one token t that is compatible with the
last token of the prefix before t (the pair encodes to itself), and the rest of the encoding is
that prefix's. A state therefore keeps, for each suffix of the input that a vocabulary token
properly starts with, the last token at the point where that suffix begins and how many
tokens fewer were counted there. States are finite in number; they and their transitions
are compiled when first met, and all are dropped when `MOST_EDGES` of them exist.

Chunks: a long text is cut into chunks that tasks read apart. A chunk's state map is a table from entry
states to exit state and tokens added, a row a state. At first it has the state that reading the
characters before the chunk leads to; that is the true one where a cut that never changes a count
(before a space that a non-space follows) lies among them, and nearly always else, since the automaton
forgets. Then the maps are closed: where a chunk's exit is no entry of the next one, the next one
is read from that state too, until every exit is an entry. Closed maps compose associatively, and a text's
count comes from a tree of Spark rounds over its chunks, `FAN_IN` maps to one.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.bpe import byte_characters, merge_symbols
from stayline.llm.byte_ids import units
from stayline.llm.common import kept, text_of

MOST_EDGES, MOST_PAIRS, MOST_UNITS, LONGEST_UNIT = 800_000, 500_000, 500_000, 64
_LETTER, _NUMBER, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
#: Maps composed in one group.
FAN_IN = 64
#: What the pre-tokenizer takes off after an apostrophe at the start of a pre-token.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}

BpeState = tuple  # (suffix, ((length, last token, count difference), ...))
State = tuple  # (mode, BPE state, pending character)


class BpeAutomaton:
    ROOT: BpeState = (b"", ((0, -1, 0),))

    def __init__(self, vocab: dict[str, int], merges: list):
        byte = {c: b for b, c in enumerate(byte_characters())}
        spelled = {s: i for s, i in vocab.items() if all(c in byte for c in s)}
        self.bytes_of = {i: bytes(byte[c] for c in s) for s, i in spelled.items()}
        self.token_of = {b: i for i, b in self.bytes_of.items()}
        self.single = [self.token_of[bytes([b])] for b in range(256)]
        self.starts = {b[:n] for b in self.token_of for n in range(1, len(b))}
        self.merges = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.pairs: dict[tuple[int, int], bool] = {}

    def _encode(self, data: bytes) -> list[int]:
        return merge_symbols([self.single[b] for b in data], self.merges)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens (left -1: none) encode to themselves."""
        found = self.pairs.get((left, right))
        if found is None:
            before = self.bytes_of[left] if left >= 0 else b""
            want = [left, right] if left >= 0 else [right]
            found = self._encode(before + self.bytes_of[right]) == want
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def step(self, state: BpeState, byte: int) -> tuple[BpeState, int]:
        suffix, chain = state
        end, size = bytes([byte]), len(suffix)
        for length, last, less in chain:
            token = self.token_of.get(suffix[size - length:] + end)
            if token is not None and self.compatible(-1, token) and (last < 0 or self.compatible(last, token)):
                delta = less + 1
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        kept = [(n + 1, t, d - delta) for n, t, d in chain if suffix[size - n:] + end in self.starts]
        longest = kept[0][0] if kept else 0
        return ((suffix + end)[size + 1 - longest:], (*kept, (0, token, 0))), delta

    def feed(self, state: BpeState, text: str) -> tuple[BpeState, int]:
        total = 0
        for byte in text.encode():
            state, delta = self.step(state, byte)
            total += delta
        return state, total


class Node:
    """A compiled state; edges: character -> (node reached, change of the count)."""

    __slots__ = ("state", "edges")

    def __init__(self, state: State):
        self.state: State = state
        self.edges: dict[str, tuple[Node, int]] = {}


class Transducer:
    START: State = ("start", BpeAutomaton.ROOT, "")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.bpe = BpeAutomaton(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.nodes: dict[State, Node] = {}
        self.compiled = 0
        self.unit_counts: dict[str, int] = {}
        self.kinds: dict[str, str] = {}

    def kind(self, char: str) -> str:
        found = self.kinds.get(char)
        if found is None:
            found = "letter" if _LETTER.match(char) else "number" if _NUMBER.match(char) \
                else "space" if _SPACE.match(char) else "other"
            self.kinds[char] = found
        return found

    def _open(self, char: str, before: str = "") -> tuple[State, int]:
        """Begin a pre-token with an optional space and a character that isn't one."""
        bpe, count = self.bpe.feed(BpeAutomaton.ROOT, before + char)
        if char == "'" and not before:
            return ("quote", bpe, ""), count
        return (self.kind(char), bpe, ""), count

    def step(self, state: State, char: str) -> tuple[State, int]:
        """One transition: the state reached and the change of the count."""
        mode, bpe, pending = state
        kind, feed, root = self.kind(char), self.bpe.feed, BpeAutomaton.ROOT
        if mode == "space":
            last, own = feed(bpe, pending)
            if kind == "space":  # the run goes on; its last character stays pending
                return ("space", last, char), feed(last, char)[1]
            if pending == " ":
                reached, more = self._open(char, " ")
                return reached, more - own
            reached, more = self._open(char)
            return reached, feed(root, pending)[1] + more - own
        if kind == "space":
            return ("space", root, char), feed(root, char)[1]
        if mode == "quote" and char in SHORT:
            return self.START, feed(root, "'" + char)[1] - feed(root, "'")[1]
        if mode == "quote" and char in LONG:
            bpe, count = feed(root, char)
            return ("quoted", bpe, char), count
        if mode == "quoted" and LONG[pending] == char:
            apart = feed(root, "'")[1] + feed(root, pending)[1]
            return self.START, feed(root, "'" + pending + char)[1] - apart
        run = {"quote": "other", "quoted": "letter"}.get(mode, mode)
        if run == kind:
            bpe, count = feed(bpe, char)
            return (run, bpe, ""), count
        return self._open(char)

    def _node(self, state: State) -> Node:
        found = self.nodes.get(state)
        if found is None:
            found = self.nodes[state] = Node(state)
        return found

    def _compile(self, node: Node, char: str) -> tuple[Node, int]:
        reached, more = self.step(node.state, char)
        self.compiled += 1
        if self.compiled > MOST_EDGES:  # start anew; whoever holds a node goes on with it
            for old in self.nodes.values():
                old.edges = {}
            self.nodes.clear()
            self.compiled = 0
        found = node.edges[char] = self._node(reached), more
        return found

    def run(self, state: State, text: str) -> tuple[State, int]:
        node, total = self._node(state), 0
        for char in text:
            node, more = node.edges.get(char) or self._compile(node, char)
            total += more
        return node.state, total

    def _unit(self, unit: str) -> int:
        found = self.unit_counts.get(unit)
        if found is None:
            found = self.run(self.START, unit)[1]
            if len(self.unit_counts) >= MOST_UNITS:
                self.unit_counts.clear()
            if len(unit) <= LONGEST_UNIT:
                self.unit_counts[unit] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token of its own."""
        plain, specials = [text], 0
        if "<|" in text:
            plain = self.special.split(text)
            specials = len(plain) - 1
        known = self.unit_counts
        return specials + sum(
            known[u] if u in known else self._unit(u) for part in plain for u in units(part))

    def entry(self, before: str) -> State:
        """The state that a stretch of text leads to, read from its last cut on; a guess where it has none."""
        return self.run(self.START, units(before)[-1])[0] if before else self.START


def spelled(state: State) -> str:
    """A state as a key: equal states are written alike."""
    return repr(state)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


_MAPS = "row long, piece long, at long, entry string, exit string, n long"


def _map_rows(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Chunks (row, piece, at, before, chunk, entry) to rows of their maps; a null entry is found from `before`."""
    model = transducer(tokenizer)
    for batch in batches:
        entries, exits, counts = [], [], []
        for before, chunk, entry in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            state = model.entry(before) if entry is None else ast.literal_eval(entry)
            reached, n = model.run(state, chunk)
            entries.append(spelled(state))
            exits.append(spelled(reached))
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(entries, pa.string()), pa.array(exits, pa.string()), pa.array(counts, pa.int64())],
            names=["row", "piece", "at", "entry", "exit", "n"])


def closed_maps(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """State maps (row, piece, at, entry, exit, n) of stored chunks, in which every exit is an entry of the next."""
    mapper = lambda b: _map_rows(b, tokenizer)
    columns = ["row", "piece", "at", "before", "chunk"]
    maps = kept(chunks.select(*columns, F.lit(None).cast("string").alias("entry")).mapInArrow(mapper, _MAPS))
    new = maps
    while True:
        asked = new.select("row", "piece", (F.col("at") + 1).alias("at"), F.col("exit").alias("entry")).distinct()
        missing = asked.join(maps, ["row", "piece", "at", "entry"], "left_anti")
        new = kept(chunks.select(*columns).join(missing, ["row", "piece", "at"]).select(*columns, "entry").mapInArrow(mapper, _MAPS))
        if new.isEmpty():
            return maps
        maps = maps.unionByName(new)


def composed(maps: DataFrame, chunks: int) -> DataFrame:
    """Closed maps of up to `chunks` chunks a piece, composed FAN_IN at a time: a map a piece is left, `at` 0."""

    def compose(rows: pa.Table) -> pa.Table:
        steps: dict[int, dict[str, tuple[str, int]]] = {}
        for at, entry, leave, n in zip(*(rows.column(c).to_pylist() for c in ("at", "entry", "exit", "n")), strict=True):
            steps.setdefault(at, {})[entry] = leave, n
        first, *rest = sorted(steps)
        out = []
        for entry, (state, n) in steps[first].items():
            for at in rest:
                state, more = steps[at][state]
                n += more
            out.append((entry, state, n))
        one = rows.select(["row", "piece"]).slice(0, 1)
        row, piece = (one.column(c)[0].as_py() for c in ("row", "piece"))
        return pa.table({
            "row": pa.array([row] * len(out), pa.int64()), "piece": pa.array([piece] * len(out), pa.int64()),
            "at": pa.array([first // FAN_IN] * len(out), pa.int64()), "entry": pa.array([o[0] for o in out], pa.string()),
            "exit": pa.array([o[1] for o in out], pa.string()), "n": pa.array([o[2] for o in out], pa.int64())})

    while chunks > 1:
        maps = maps.groupBy("row", "piece", F.expr(f"at div {FAN_IN}").alias("group")).applyInArrow(compose, _MAPS)
        chunks = -(-chunks // FAN_IN)
    return maps


def count_tokens(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", chunk: int = 65_536, look_back: int = 256,
) -> DataFrame:
    """Per row: key, n_bytes and n_tokens.

    Null and empty texts have no tokens. Texts of more than `chunk` characters are cut into chunks
    that are worked on apart and composed; their first entries come from the `look_back` characters before them.
    Rows are kept one to one, repeated rows and null keys included; an empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(tokenizer)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([model.count(t) for t in texts], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = sized.filter(~long).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")

    # A special string that a cut would part must stay whole: pieces between special strings are chunked.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(tokenizer)
        names = ["row", "doc_id", "n_bytes", "piece", "at", "before", "chunk"]
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc_id, n_bytes, text = (c[i].as_py() for c in batch.columns)
                for k, piece in enumerate(model.special.split(text)):
                    for at in range(0, max(1, len(piece)), chunk):
                        own = (row, doc_id, n_bytes, k, at // chunk, piece[max(0, at - look_back):at], piece[at:at + chunk])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], pa.string() if n in ("before", "chunk") else pa.int64()) for n, v in zip(names, own, strict=True)],
                            names=names)

    chunks = kept(sized.filter(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text").mapInArrow(
        cut, "row long, doc_id long, n_bytes long, piece long, at long, before string, chunk string")
        .repartition("row", "piece", "at"))
    most = chunks.agg(F.max("at")).first()[0]
    if most is None:
        return short
    pieces = composed(closed_maps(chunks, tokenizer), most + 1).filter(F.col("entry") == spelled(Transducer.START))
    totals = pieces.groupBy("row").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("n_tokens"))  # special strings stand between
    known = chunks.filter("piece = 0 and at = 0").select("row", "doc_id", "n_bytes")
    return short.unionByName(known.join(totals, "row").select("doc_id", "n_bytes", "n_tokens"))
