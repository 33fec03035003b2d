"""Vector bin packing of token streams into sequences (operator 9).

Every task packs the rows of its own input partition, so nothing is shuffled and no group meets in
one task. Items wait in a bounded window; the open sequence takes the item with the largest dot
product between the item's demand and what is left of the sequence (tokens, segments, loss-bearing
tokens, each as a share of its limit). Items may be cut: what no whole item fills is filled by a part
of one. A sequence that cannot be filled is cut back to a power of two, which needs no padding.

Defined results: a null or empty text is its end token alone; repeated rows are packed one by one;
a text longer than a sequence becomes full sequences and a rest; strings of added tokens inside a text
are those tokens, as the library reads them; rows without an id are packed too; an empty table gives an empty result.
Sequence ids are unique by partition and the same again when a task is repeated.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, in_parts, table, worker_memo

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048
    window: int = 512  # items that wait at once in a task


#: For plain documents: the first tokens of each, at most a quarter of it, have little before them and
#: bear no loss, and a sequence holds a few such tokens at least.
QUIET_HEAD = 64
DOCUMENTS = Limits(segments=8, loss_tokens=2032)


#: The pattern by which byte-level tokenizer files cut texts into pieces (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class HubTokenizer:
    """Little-endian 32-bit ids of texts by a ``tokenizers`` file, added tokens in texts included, as the library gives them.

    A plain byte-level file whose merges are in the order of their ids is a table of ranks; ids then come
    from a rank coder, which gives the same ids several times faster. Other files, and texts that the
    coder refuses (white space by the million), go to the library.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.ranks = rank_coder(path, self.added)

    def encode(self, text: str) -> bytes:
        if self.ranks:
            try:
                return np.frombuffer(self.ranks.encode_to_numpy(text, allowed_special="all"), "<u4").tobytes() + self.end
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


def rank_coder(path: str, added: dict[str, int]):
    """The file as ranks for ``tiktoken``; None unless both mean the same."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and parts["normalizer"] is None and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    single = sum(len(t) == 1 for t in ranks)
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if single != 256 or len(ranks) != 256 + len(merges) or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)


def tokenizer(path: str, end_id: int) -> HubTokenizer:
    """One tokenizer a Python worker, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_memo(("tokenizer", path, end_id), lambda: HubTokenizer(path, end_id))


class Packer:
    """Packs (key, total, start, length, loss) items; ``emit(key, total, start, length, loss, sequence, offset)``."""

    def __init__(self, limits: Limits, emit, first_sequence: int):
        self.limits, self.emit, self.sequence = limits, emit, first_sequence
        self.scale = np.array([limits.tokens, limits.segments, max(limits.loss_tokens, 1)], dtype=float)
        self.items: list[tuple] = []
        self.need = np.empty((0, 3))

    def add(self, key, ids_total: int, loss_from: int) -> None:
        """A document: full sequences at once where limits allow, the rest waits."""
        size, start = self.limits.tokens, 0
        while ids_total - start >= size and self.loss(start, start + size, loss_from) <= self.limits.loss_tokens:
            self.emit(key, ids_total, start, size, self.loss(start, start + size, loss_from), self.sequence, 0)
            self.sequence += 1
            start += size
        while start < ids_total:
            end = min(ids_total, start + size)
            if self.limits.loss_tokens < size:
                end = min(end, max(start, loss_from) + self.limits.loss_tokens)
            self.items.append((key, ids_total, start, end, loss_from))
            start = end
        if len(self.items) >= 2 * self.limits.window:
            self.pack(self.limits.window)

    @staticmethod
    def loss(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def pack(self, leave: int) -> None:
        """Close sequences until at most ``leave`` items wait."""
        demand = np.array([(e - s, 1, self.loss(s, e, f)) for _, _, s, e, f in self.items], dtype=float).reshape(-1, 3)
        alive = np.ones(len(self.items), dtype=bool)
        waiting = len(self.items)
        while waiting > leave:
            waiting -= self.fill(demand, alive)
        self.items = [item for item, keep in zip(self.items, alive) if keep]

    def fill(self, demand: np.ndarray, alive: np.ndarray) -> int:
        """Fill one sequence; how many items it used up."""
        left = self.scale.copy()
        chosen: list[int] = []
        while left[0] > 0 and left[1] > 0:
            fits = alive & (demand <= left).all(axis=1)
            if left[1] == 1:
                fits &= demand[:, 0] == left[0]  # the last segment must close the sequence, else part of one does
            if not fits.any():
                break
            score = np.where(fits, (demand / self.scale) @ (left / self.scale), -1.0)
            best = int(score.argmax())
            chosen.append(best)
            alive[best] = False
            left -= demand[best]
        pieces = [self.items[i] for i in chosen]
        if left[0] > 0 and left[1] > 0 and alive.any():
            pieces += self.part(demand, alive, left)
        return len(chosen) - self.close(pieces, demand, alive, chosen)

    def part(self, demand, alive, left) -> list[tuple]:
        """A cut from a waiting item that fills the sequence, or as much of it as limits allow."""
        room, loss_room = int(left[0]), int(left[2])
        where = np.flatnonzero(alive & (demand[:, 0] > 1))
        if not len(where):
            return []
        size, quiet = demand[where, 0], demand[where, 0] - demand[where, 2]  # what bears no loss comes first
        takes = np.minimum(np.minimum(room, size - 1), quiet + loss_room)
        best = int(np.lexsort((-size, -takes))[0])
        best, best_take = int(where[best]), int(takes[best])
        if best_take <= 0:
            return []
        key, total, start, end, loss_from = self.items[best]
        self.items[best] = (key, total, start + best_take, end, loss_from)
        demand[best] = (end - start - best_take, 1, self.loss(start + best_take, end, loss_from))
        return [(key, total, start, start + best_take, loss_from)]

    def close(self, pieces: list[tuple], demand, alive, chosen) -> int:
        """Emit a sequence; one that is not full is cut back to a power of two. How many rests went back to wait."""
        length = sum(e - s for _, _, s, e, _ in pieces)
        target = length if length == self.limits.tokens else 1 << (length.bit_length() - 1)
        offset, back = 0, 0
        rests = []
        for key, total, start, end, loss_from in pieces:
            take = min(end - start, target - offset)
            if take:
                self.emit(key, total, start, take, self.loss(start, start + take, loss_from), self.sequence, offset)
                offset += take
            if take < end - start:
                rests.append((key, total, start + take, end, loss_from))
        self.sequence += 1
        free = iter(chosen)
        for rest in rests:
            place = next((i for i in free if not alive[i]), None)
            if place is None:  # the cut came from a waiting item: give the rest back to it
                for i in np.flatnonzero(alive):
                    key, total, start, end, loss_from = self.items[i]
                    if (key, total, start) == (rest[0], rest[1], rest[3]):
                        self.items[i] = (key, total, rest[2], end, loss_from)
                        demand[i] = (end - rest[2], 1, self.loss(rest[2], end, loss_from))
                        break
                continue
            self.items[place] = rest
            demand[place] = (rest[3] - rest[2], 1, self.loss(rest[2], rest[3], rest[4]))
            alive[place] = True
            back += 1
        return back


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), key: str = "doc_id", text: str = "text",
    loss_from: str | None = None, quiet_head: int = 0,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with a checksum of its ids.

    ``loss_from`` names a column with the number of tokens at a row's start that bear no loss (null: none);
    without it these are the first ``quiet_head``, at most a quarter of the row's.
    """

    def run(batches):
        own = tokenizer(tokenizer_path, end_id)
        out: list[tuple] = []
        ids_of: dict[int, list] = {}  # by serial number of the document: ids and how many of them are not emitted yet

        def emit(serial, total, start, length, loss, sequence, offset):
            doc_id, ids, left = ids_of[serial]
            out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset, loss))
            if left == length:
                del ids_of[serial]
            else:
                ids_of[serial][2] = left - length

        def rows():
            done, columns = out[:], list(zip(*out))
            out.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if done:
                yield from in_parts(pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 40)
        serial = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text_value, first in zip(*(part.column(i).to_pylist() for i in range(3))):
                    ids = own.encode(text_value or "")
                    size = len(ids) // 4
                    ids_of[serial] = [doc_id, ids, size]
                    packer.add(serial, size, min(quiet_head, size // 4) if first is None else first)
                    serial += 1
                yield from rows()
        packer.pack(0)
        yield from rows()

    bound_batches(docs.sparkSession)
    first = f"coalesce(cast(`{loss_from}` as long), 0L)" if loss_from else "cast(null as long)"
    return docs.selectExpr(f"cast(`{key}` as long) as k", f"cast(`{text}` as string) as t", f"{first} as f").mapInArrow(run, SCHEMA)


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), limits=DOCUMENTS, quiet_head=QUIET_HEAD)
