"""SentencePiece encoding and decoding as weighted finite-state transduction.

``compile_model`` turns a model file into one transducer, a chain of three machines that are composed with each input:

- the normaliser: the model's normalisation map as longest-match rewriting arcs, the states of white space (leading,
  repeated, trailing), the dummy prefix and the space escape; user-defined pieces pass it as they are,
- the lexicon: one arc path a piece, with the piece's weight, and byte fallback for characters that no piece has,
- for BPE models, the acceptor of merge order. Its states are pieces and it has an arc from piece to piece exactly if
  merging their characters would give these two again (found by undoing merges on both sides of the cut, latest
  first), since no sums of weights can tell which merges come first.

Encoding takes the shortest path through the composition in the tropical semiring: weights add along a path, the
least sum wins, for unigram and BPE models alike. A piece weighs its negative score. The composition is made while it is
read: an Aho-Corasick machine gives the lexicon's arcs by the position where they end, and each arc that the acceptor
lets follow the state of its start is relaxed. One state a position is enough: a unigram model's acceptor has one, and in
merge order the pieces of each prefix of a text are determined, so only its last piece can be alive there. Texts are cut
where no piece crosses: at an escaped space after another character, and between characters that no chain of pieces joins,
as letters of one script and punctuation (both found when compiled). The chunks between are composed separately, those
that are new to a group of texts in sorted order: each goes on from the states of the prefix that it shares with the one
before.

Defined results: null and empty texts have no tokens and decode to the empty string (null for null); decoding gives the
normalised text back, which for an identity normaliser is the text itself but for U+2581 (the escape, which comes back
as a space); repeated rows are encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, n_bytes_fallback long, ids_sha256 string, round_trip boolean"
#: Weight of a byte arc; above any piece's, so that bytes serve only what no piece has.
BYTE_WEIGHT = 1e6
#: Chunks that a task remembers, twice (those met last and those before), the longest of them, and pairs of pieces.
REMEMBERED, REMEMBERED_LENGTH, PAIRS = 60_000, 64, 100_000
#: Texts that are encoded, decoded and handed on together.
AT_ONCE = 256
#: Steps of the lexicon's machine that a task remembers.
STEPS = 50_000
#: Chunks that are looked up together; those not met before are composed in sorted order.
TOGETHER = 200_000
#: Sets of joined characters that are told apart where texts are cut; all others count as one.
CLASSES = 32
#: Characters of a chunk from which costs are kept in arrays; no sum of weights.
LONG_CHUNK, INFINITE = 4096, float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Normaliser:
    """Rewriting arcs and the states of white space. ``rules``: text to its rewriting; ``keep``: user-defined pieces."""

    rules: dict[str, str]
    keep: tuple[str, ...]
    dummy_prefix: bool
    strip: bool
    space: str

    def __post_init__(self):
        self.longest = max(map(len, self.rules), default=0)
        firsts = "".join(sorted({r[0] for r in self.rules}))
        known = "|".join(map(re.escape, sorted(self.keep, key=len, reverse=True)))
        self.stop = re.compile("|".join(x for x in (known and f"({known})", firsts and f"[{re.escape(firsts)}]") if x)) if known or firsts else None

    def rewritten(self, text: str) -> str:
        """The longest rule at each place, from the left."""
        if self.stop is None:
            return text
        out, at = [], 0
        while (m := self.stop.search(text, at)) is not None:
            out.append(text[at : m.start()])
            at = m.start()
            if self.keep and m.group(1):
                out.append(m.group(1))
                at = m.end()
                continue
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.rules.get(text[at : at + n])) is not None:
                    out.append(new)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        """The machine's output, spaces escaped."""
        if not text:
            return ""
        text = self.rewritten(text)
        if self.strip:
            if text and not text.strip(" "):
                return ""
            text = re.sub(" {2,}", " ", text).strip(" ")
            if not text:
                return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", self.space)


@dataclass
class Transducer:
    pieces: list[str]
    bpe: bool
    normal: Normaliser
    arcs: dict[str, tuple[int, float]]  # piece to id and weight
    byte_ids: list[int]
    unk: int
    rank: list[int]
    split: dict[int, tuple[int, int]]
    merged: dict[int, int]  # a pair's name to what it is merged into
    own: dict[str, int]  # user-defined pieces
    chunk: re.Pattern | None  # what is composed separately; None: whole texts
    pairs: dict[int, bool] = field(default_factory=dict)
    known: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)
    steps: dict[str, tuple] = field(default_factory=dict)
    surface: list[bytes] = field(default_factory=list)
    machine: ahocorasick.Automaton | None = None

    def __post_init__(self):
        self.size = {t: len(p) for p, (t, _) in self.arcs.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None

    def follows(self, a: int, b: int) -> bool:
        """The merge-order acceptor's arc from piece ``a`` to piece ``b``."""
        name = a << 20 | b
        ok = self.pairs.get(name)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[name] = self._follows(a, b)
        return ok

    def _follows(self, a: int, b: int) -> bool:
        rank, limit = self.rank, 1 << 60
        while True:
            c = self.merged.get(a << 20 | b)
            if c is not None and rank[c] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # the later merge is undone first; at the same rank the left one came first
            if rank[a] > rank[b]:
                limit, a = rank[a], self.split[a][1]
            else:
                limit, b = rank[b] + 1, self.split[b][0]

    def lexicon(self):
        """The pieces by their prefixes; built in each worker."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for p, (t, w) in self.arcs.items():
                self.machine.add_word(p, (t, len(p), w))
            self.letters = frozenset(p for p in self.arcs if len(p) == 1)
            self.steps.clear()
        return self.machine

    def step(self, read: str) -> tuple:
        """The Aho-Corasick machine's arc from its state, the longest prefix of a piece that ends where it is, by one more
        character: the next state, and the lexicon's arcs that end there, longest first (piece, length, weight; -1: the
        bytes of a character that is no piece). ``read``: the state and the character."""
        if len(self.steps) >= STEPS:
            self.steps.clear()
        name, arcs = read, [a for i in range(len(read)) if (a := self.machine.get(read[i:], None))]
        if read[-1] not in self.letters:
            arcs.append((-1, 1, BYTE_WEIGHT))
        while read and not self.machine.match(read):
            read = read[1:]
        self.steps[name] = found = read, tuple(arcs)
        return found

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path for one normalised chunk."""
        return next(self.paths([text]))

    def paths(self, texts):
        """Ids along the shortest path for each of some normalised chunks. ``cost``: the least sum of weights to each
        position; ``last``: the piece that ends there on the best path (-1: the start, or bytes). Both are the same for
        all texts with the same prefix, so a chunk keeps what the one before has found for the prefix they share."""
        self.lexicon()
        bpe, pairs, steps, old, cost, last, states = self.bpe, self.pairs, self.steps, "", [0.0], [-1], [""]
        for text in texts:
            n, at = len(text), 0
            if n >= LONG_CHUNK:
                old, cost, last = "", array("d", [0.0]), array("i", [-1])
            elif len(old) >= LONG_CHUNK:
                old, cost, last = "", [0.0], [-1]
            for x, y in zip(old, text):
                if x != y:
                    break
                at += 1
            del cost[at + 1 :], last[at + 1 :], states[at + 1 :]
            state = states[at]
            for c in text[at:]:
                at += 1
                state, arcs = steps.get(read := state + c) or self.step(read)
                least, piece = INFINITE, -1
                for t, size, w in arcs:
                    if (to := cost[at - size] + w) < least:
                        if bpe and (before := last[at - size]) >= 0 and t >= 0:
                            ok = pairs.get(before << 20 | t)
                            if not (self.follows(before, t) if ok is None else ok):
                                continue
                        least, piece = to, t
                cost.append(least)
                last.append(piece)
                if n < LONG_CHUNK:
                    states.append(state)
            out, j, old = [], n, text
            while j > 0:
                if (t := last[j]) >= 0:
                    out.append(t)
                    j -= self.size[t]
                else:
                    j -= 1
                    out += [self.byte_ids[x] for x in reversed(text[j].encode())] if self.byte_ids else [self.unk]
            out.reverse()
            yield out

    def _compose(self, held) -> None:
        """Append to each array the ids of its chunks."""
        if len(self.known) >= REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*[chunks for _, chunks in held]).difference(known)
        known.update((c, before[c]) for c in new.intersection(before))
        known.update((c, array("I", [self.own[c]]).tobytes()) for c in new.intersection(self.own))
        fresh = sorted(new.difference(before, self.own))
        known.update((c, array("I", ids).tobytes()) for c, ids in zip(fresh, self.paths(fresh)))
        for ids, chunks in held:
            ids.frombytes(b"".join(map(known.__getitem__, chunks)))
        for c in fresh:
            if len(c) >= REMEMBERED_LENGTH:
                del known[c]

    def forget(self) -> None:
        """Drop what was remembered, so that an idle worker holds the model only."""
        self.known, self.before = {}, {}
        self.pairs.clear()
        self.steps.clear()

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[array]:
        """Ids of each text (null: none)."""
        out, held, n = [array("I") for _ in texts], [], 0
        for ids, text in zip(out, texts, strict=True):
            text = self.normal(text or "")
            for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
                chunks = self.chunk.findall(part) if self.chunk and k % 2 == 0 else [part] if part else []
                for a in range(0, len(chunks), TOGETHER):
                    held.append((ids, chunks[a : a + TOGETHER]))
                    if (n := n + len(held[-1][1])) >= TOGETHER:
                        self._compose(held)
                        held, n = [], 0
        self._compose(held)
        return out

    def plain(self, text: str) -> str:
        """What decoding gives back: the normalised text."""
        text = self.normal(text).replace(self.normal.space, " ").replace(SPACE, " ")
        return text[1:] if self.normal.dummy_prefix and text[:1] == " " else text

    def decode(self, ids) -> str:
        if not self.surface:
            self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
            self.surface[self.unk] = " ⁇ ".encode()
            for x, t in enumerate(self.byte_ids):
                self.surface[t] = bytes([x])
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normal.dummy_prefix and text[:1] == " " else text


def chunks_of(pieces) -> re.Pattern:
    """A chunk for pieces that have spaces at their start only: spaces and then characters that pieces join, directly or
    through others, or one that no piece joins to any."""
    leader: dict[str, str] = {}

    def find(c: str) -> str:
        while leader.setdefault(c, c) != c:
            leader[c] = c = leader[leader[c]]
        return c

    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:]):
            leader[find(a)] = find(b)
    sets: dict[str, list[str]] = {}
    for c in sorted(leader):
        sets.setdefault(find(c), []).append(c)
    sets = sorted(sets.values(), key=len, reverse=True)
    sets = sets[: CLASSES - 1] + ([sum(sets[CLASSES - 1 :], [])] if len(sets) >= CLASSES else [])
    runs = "".join(f"[{re.escape(''.join(x))}]+|" for x in sets)
    return re.compile(f"{SPACE}*(?:{runs}[^{SPACE}])|{SPACE}+")


def _fields(data: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


def _merge(text: str, ids: dict[str, int], rank: dict[str, int]):
    """Merge the best pair, the leftmost of equals, until none is left; returns the pieces before the last merge too."""
    parts, before = list(text), None
    while True:
        best = min(((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank), default=None)
        if best is None:
            return parts, before
        before = list(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def read_rules(data: bytes) -> dict[str, str]:
    """The rules of a serialised normalisation map: a double array of byte transitions whose leaves point into a run of
    null-ended rewritings."""
    if not data:
        return {}
    size = struct.unpack("<I", data[:4])[0]
    units, texts, rules, left = np.frombuffer(data[4 : 4 + size], "<u4").astype(np.int64), data[4 + size :], {}, [(0, b"")]
    symbols = np.arange(1, 256)

    def behind(at: int) -> int:
        u = int(units[at])
        return at ^ ((u >> 10) << ((u & 512) >> 6))

    while left:
        at, so_far = left.pop()
        to = behind(at) ^ symbols
        to = np.where(to < len(units), to, 0)
        for c in symbols[(units[to] & 0x800000FF) == symbols].tolist():
            child = behind(at) ^ c
            if units[child] >> 8 & 1:
                value = int(units[behind(child)]) & 0x7FFFFFFF
                rules[(so_far + bytes([c])).decode()] = texts[value : texts.index(b"\0", value)].decode()
            left.append((child, so_far + bytes([c])))
    return rules


def compile_model(path: str) -> Transducer:
    """Read a model file (its fields 1: pieces, 2: trainer, 3: normaliser) and build the transducer."""
    pieces, scores, kinds, model_type, byte_fallback, suffix, charsmap, dummy, strip, escape = [], [], [], 1, False, False, b"", True, True, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                p = dict(_fields(value))
                pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, 1))
            elif number == 2:
                p = dict(_fields(value))
                model_type, byte_fallback, suffix = p.get(3, model_type), bool(p.get(35, byte_fallback)), bool(p.get(24, suffix))
            elif number == 3:
                p = dict(_fields(value))
                charsmap, dummy, strip, escape = p.get(2, charsmap), bool(p.get(3, dummy)), bool(p.get(4, strip)), bool(p.get(5, escape))
    bpe, own = model_type == 2, {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 4}
    if model_type not in (1, 2) or suffix or (own and not bpe):
        raise ValueError("only unigram and BPE models with spaces before words, and user-defined pieces of BPE models, are compiled")
    normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
    unk = kinds.index(2)
    byte_ids = [0] * 256 if byte_fallback else []
    for i, k in enumerate(kinds):
        if k == 6 and byte_fallback:
            byte_ids[int(pieces[i][3:5], 16)] = i
    rank, split, merged = [-1] * len(pieces), {}, {}
    if bpe:
        order = {p: i for i, p in enumerate(sorted((p for p in normal if len(p) > 1), key=lambda p: (-scores[normal[p]], normal[p])))}
        arcs = {p: (i, -scores[i]) for p, i in normal.items() if len(p) == 1}
        for p, r in order.items():
            if any(c not in normal for c in p):
                raise ValueError("a piece holds a character that is no piece")
            parts, before = _merge(p, normal, order)
            i = normal[p]
            rank[i] = r
            if len(parts) == 1:  # else merging never gives this piece
                arcs[p], split[i] = (i, -scores[i]), (normal[before[0]], normal[before[1]])
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    merged[normal[p[:k]] << 20 | normal[p[k:]]] = i
    else:
        arcs = {p: (i, -scores[i]) for p, i in normal.items()}
    crossing = not escape or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
    machine = Normaliser(read_rules(charsmap), tuple(own), dummy, strip, SPACE if escape else " ")
    return Transducer(pieces, bpe, machine, arcs, byte_ids, unk, rank, split, merged, own, None if crossing else chunks_of(normal))


def encode_decode(docs: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", with_output: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_bytes_fallback, ids_sha256 (little-endian 32-bit ids), round_trip
    (decoding gives the text again) and, if asked for, ids and decoded."""
    # the compiled vocabulary: bounded by the model file, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(model_path or default_model()))

    def run(batches):
        t = shared.value
        is_byte = np.isin(np.arange(len(t.pieces)), t.byte_ids)
        for batch in (b.slice(a, AT_ONCE) for b in batches for a in range(0, b.num_rows, AT_ONCE)):
            texts = batch.column("text").to_pylist()
            ids = t.encode_all(texts)
            back = [t.decode(i) for i in ids]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "n_bytes_fallback": pa.array([int(is_byte[np.frombuffer(i, np.uint32)].sum()) if len(i) else 0 for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                "round_trip": pa.array([b == t.plain(x or "") for b, x in zip(back, texts, strict=True)], pa.bool_()),
            }
            if with_output:
                out["ids"] = pa.array([list(i) for i in ids], pa.list_(pa.int64()))
                out["decoded"] = pa.array([None if x is None else b for b, x in zip(back, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)
        t.forget()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<bigint>, decoded string" * with_output)
