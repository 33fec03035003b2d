"""Byte-level BPE as a lazily determinised transducer, with a streaming UTF-8 decoder (operator 10).

Encoding. For every prefix of a piece the merges fix one last token, and a token may follow another
exactly if merging the two alone leaves them apart. Reading bytes left to right, a state therefore
holds the prefixes from which some vocabulary entry can still grow, each with its last token, as a
small tree. Tokens that all branches share are emitted: lookahead is bounded by the longest entry.
The token emitted last stays in a register and guards the arcs that depend on it. States and arcs
are made when first met and kept in tables (bounded; they start anew when full), so
a byte normally costs one table lookup. Pieces come from the library's pattern; units of text are
memoised.

Decoding. Ids give bytes part by part; an incremental UTF-8 automaton carries an unfinished
character from one part to the next.

Defined results: null text is empty (no ids, hash of nothing); repeated rows are coded one by one;
long texts are processed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .units import UnitMemo, piece_splitter, split_units

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain merging of the neighbours with the lowest rank; used on token pairs and in tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """``encode`` gives the ids of one piece. See the module text for states and arcs."""

    def __init__(self, ranks: dict[bytes, int], most_arcs: int = 350_000):
        self.ranks, self.most_arcs = ranks, most_arcs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for entry, rank in ranks.items():
            node = 0
            for byte in entry:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][byte]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.restart()

    def restart(self) -> None:
        # A state: nodes (parent's place or -1, last token, trie node or -1 if nothing can grow there).
        # Node 0 is the last settled prefix; its token is in a register beside the state, so that states
        # depend on pending bytes only. The last node is the newest prefix.
        self.states: list[tuple] = [((-1, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, list] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two entries whose merge makes ``token``; (-1, -1) for a byte or an entry that merging never reaches."""
        known = self.split.get(token)
        if known is None:
            whole = self.bytes_of[token]
            lower = {b: r for n in range(1, len(whole)) for i in range(len(whole) - n + 1) if (r := self.ranks.get(b := whole[i : i + n])) is not None}
            parts = merge_by_rank(lower, whole) if lower else ()
            known = self.split[token] = tuple(parts) if len(parts) == 2 else (-1, -1)
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging never joins across the border: undo merges on both sides, latest first.

        A join of the entries at the border would happen if it ranks before the merges that consumed
        them; of equal ranks the one further left goes first.
        """
        rank_of, of = self.ranks.get, self.bytes_of
        left_until = right_until = 1 << 40
        while True:
            joint = rank_of(of[left] + of[right], 1 << 40)
            if joint < left_until and joint <= right_until:
                return False
            left_parts, right_parts = self.halves(left), self.halves(right)
            if left_parts[0] < 0 and right_parts[0] < 0:
                return True
            if right_parts[0] < 0 or left_parts[0] >= 0 and left > right:
                left_until, left = left, left_parts[1]
            else:
                right_until, right = right, right_parts[0]

    def pair_fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.most_arcs:
                self.pairs.clear()
            known = len(self.bytes_of[right]) == 1 or self.halves(right)[0] >= 0
            if known and left >= 0:
                known = self.stay_apart(left, right)
            self.pairs[key] = known
        return known

    def step(self, state: tuple, byte: int, root_fits: bool) -> tuple[int, tuple[int, ...]]:
        """The state after ``byte`` and the tokens settled by it; ``root_fits`` answers the arc's question."""
        grown, new, children = [], None, self.children
        for place, (parent, token, node) in enumerate(state):
            after = children[node].get(byte, -1) if node >= 0 else -1
            if after >= 0:
                if new is None and (found := self.token_at[after]) >= 0 and (self.pair_fits(token, found) if place else root_fits):
                    new = (place, found, 0)
                if not children[after]:
                    after = -1
            grown.append((parent, token, after))
        if new is None:
            raise ValueError(f"no vocabulary entry for byte {byte}")
        grown.append(new)
        needed = [node >= 0 for _, _, node in grown]
        branches = [0] * len(grown)
        for place in range(len(grown) - 1, 0, -1):
            if needed[place]:
                parent = grown[place][0]
                needed[parent] = True
                branches[parent] += 1
        out, root = [], 0
        while grown[root][2] < 0 and branches[root] == 1:  # one way on: its token is settled
            root = next(p for p in range(root + 1, len(grown)) if needed[p] and grown[p][0] == root)
            out.append(grown[root][1])
        places, kept = {root: 0}, [(-1, -1, grown[root][2])]
        for place in range(root + 1, len(grown)):
            if needed[place] and grown[place][0] in places:
                places[place] = len(kept)
                kept.append((places[grown[place][0]], grown[place][1], grown[place][2]))
        after = tuple(kept)
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], tuple(out)

    def arc(self, key: int) -> list:
        """[token that would grow from the settled prefix or -1, arc if it does not fit, arc if it does]."""
        node = self.children[self.states[key >> 8][0][2]].get(key & 255, -1) if self.states[key >> 8][0][2] >= 0 else -1
        found = self.arcs[key] = [self.token_at[node] if node >= 0 else -1, None, None]
        return found

    def end(self, state: int) -> tuple[int, ...]:
        nodes, out = self.states[state], []
        place = len(nodes) - 1
        while place > 0:
            out.append(nodes[place][1])
            place = nodes[place][0]
        self.ends[state] = found = tuple(out[::-1])
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.arcs) > self.most_arcs:
            self.restart()
        arcs, pairs, state, last, ids = self.arcs, self.pairs, 0, -1, []
        for byte in piece:
            key = state << 8 | byte
            arc = arcs.get(key) or self.arc(key)
            fits = 1
            if arc[0] >= 0:
                fits = pairs.get(last << 32 | arc[0])
                if fits is None:
                    fits = self.pair_fits(last, arc[0])
            found = arc[1 + fits]
            if found is None:
                found = arc[1 + fits] = self.step(self.states[state], byte, bool(fits and arc[0] >= 0))
            state, out = found
            if out:
                ids += out
                last = out[-1]
        ids += self.ends.get(state) or self.end(state)
        return ids


class Utf8Stream:
    """Incremental UTF-8: ``feed`` bytes, get the text that is complete; ill-formed parts become U+FFFD."""

    #: Lead byte ranges with the number of continuation bytes and the bounds of the first of them (fixed values).
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
             (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self):
        self.lead = {b: (n, low, high) for first, last, n, low, high in self.LEADS for b in range(first, last + 1)}
        self.restart()

    def restart(self) -> None:
        self.open = b""

    def feed(self, chunk: bytes) -> str:
        data = self.open + chunk
        whole = len(data) - self.unfinished(data)
        try:
            text, self.open = data[:whole].decode(), data[whole:]
        except UnicodeDecodeError:
            text, self.open = self.run(data)
        return text

    def unfinished(self, data: bytes) -> int:
        """How many bytes at the end begin a character that the data does not complete."""
        for back in range(1, min(3, len(data)) + 1):
            need = self.lead.get(data[-back], (0,))[0]
            if need >= back:
                return back
            if not 0x80 <= data[-back] <= 0xBF:
                break
        return 0

    def run(self, data: bytes) -> tuple[str, bytes]:
        out, i = [], 0
        while i < len(data):
            if data[i] < 0x80:
                out.append(chr(data[i]))
                i += 1
                continue
            need, low, high = self.lead.get(data[i], (0, 0, 0))
            j = i + 1
            while j < len(data) and j - i <= need and low <= data[j] <= high:
                low, high, j = 0x80, 0xBF, j + 1
            if need and j - i == need + 1:
                out.append(data[i:j].decode())
            elif need and j == len(data):
                return "".join(out), data[i:]
            else:
                out.append("�")
            i = j
        return "".join(out), b""

    def finish(self) -> str:
        return "�" if self.open else ""


class Codec:
    """Encodes texts to lists of chunks of ids (one a unit) and decodes such chunks."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.transducer = Transducer(ranks)
        self.token_bytes = self.transducer.bytes_of
        self.pieces = piece_splitter(pattern)
        self.units = UnitMemo(self.code_unit, limit=350_000)
        self.known_pieces = UnitMemo(lambda piece: tuple(self.transducer.encode(piece.encode())), limit=450_000)
        self.utf8 = Utf8Stream()

    def code_unit(self, unit: str) -> tuple[tuple[int, ...], str]:
        """Ids of a unit, and the same in decimal."""
        if len(unit) > 1 and unit[-1] in ",.!" and unit[:-1].lstrip(" ").isalpha():
            ids = self.known_pieces[unit[:-1]] + self.known_pieces[unit[-1]]  # a word and one mark: two pieces
        else:
            ids = sum(map(self.known_pieces.__getitem__, self.pieces(unit)), ())
        return ids, ",".join(map(str, ids))

    def encode(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        return list(map(self.units.__getitem__, split_units(text)))

    def decode(self, ids: Iterable[int], at_once: int = 1 << 16) -> Iterator[str]:
        """The text of a stream of ids, in parts of ``at_once`` ids; nothing else is held."""
        self.utf8.restart()
        ids = map(self.token_bytes.__getitem__, ids)
        while part := b"".join(islice(ids, at_once)):
            yield self.utf8.feed(part)
        yield self.utf8.finish()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a Python worker, kept between tasks."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def code_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and what they decode to: hashes, or with ``with_ids`` the ids and the text."""
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            rows: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
            for doc_id, text_value in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = own.encode(text_value.as_py() or "")
                ids = list(chain.from_iterable([unit[0] for unit in coded]))
                rows["doc_id"].append(doc_id)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(",".join([unit[1] for unit in coded]).encode()).hexdigest())
                decoded = "".join(own.decode(ids))
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    rows["ids"].append(ids)
                    rows["decoded"].append(decoded)
            types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.string())) for k, v in rows.items()})

    return docs.selectExpr(f"cast(`{key}` as long) as k", f"cast(`{text}` as string) as t").mapInArrow(run, schema)


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return code_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
