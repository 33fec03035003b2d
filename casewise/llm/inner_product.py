"""Maximum inner product search with score-aware quantisation and four-bit tables (operator 5).

A bounded sample trains coarse cells (k-means) and, for what a cell's centre leaves over, sixteen
centres in each two-dimensional subspace. Quantisation minimises an anisotropic loss: error parallel
to the vector, which changes its inner product with vectors like it, costs more than error across.
All rows are encoded, two codes a byte, with the length of what the code leaves over. A query visits
the cells with the largest inner products; in a cell it sums one table entry a byte over all codes,
keeps the best, and ranks those exactly, in double precision, on the original vectors. A row whose sum
could, by the length of its error, still beat the last of them is ranked exactly as well, so rows that
share a code lose nothing in the cells that are visited.

How many cells are visited is measured, not guessed: as many as hold ``wanted`` of the nearest rows of
the sample for up to ``trial`` of the queries themselves, and never less than the floors of ``Search``.
Rows further from their cell's centre than nearly all of the sample are met by every query. A query
takes along what its last row of the sample scores, so that chunks send back only what may be a result.

Cells are dealt out in chunks of bounded size. A chunk's rows reach its task first and once, then the
queries that probe its cell stream past them in batches, so neither a crowded cell nor the number of
queries can fill a task. Only the sample and one count a cell reach the driver.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part; ties go to the smaller vec_id; repeated rows are candidates of
their own, but a query never finds its own id; an id with several vectors asks with the least of them; with fewer candidates all are returned; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class Search:
    sample: int = 20_000  # vectors for training, at most
    rows_per_cell: int = 2_000
    most_cells: int = 1_024
    probe_share: float = 0.3  # of the cells, at least
    least_probes: int = 10
    trial: int = 256  # queries on which the number of cells is measured
    wanted: float = 0.99  # of their nearest rows in the sample must lie in the cells they visit
    near_share: float = 0.99  # of the sample; rows that lie further from their cell's centre meet every query
    parallel_weight: float = 3.0  # cost of error along the vector against error across
    rerank: int = 120  # kept by tables for each query and chunk
    chunk_rows: int = 4_096
    top: int = 20


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) with v as array<double>, finite and not zero."""
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


class Codebook:
    """Cells and subspace centres; ``fit`` on a sample, ``encode`` for any rows."""

    def __init__(self, x: np.ndarray, cells: int, p: Search, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p, self.dim = p, x.shape[1]
        self.unit = np.abs(x).max()  # tables and codes are in this unit, so that squares neither overflow nor vanish
        x = x / self.unit
        self.pairs = -(-self.dim // 4)  # bytes a row: two subspaces of two dimensions each
        self.width = self.pairs * 4
        self.cells = self._means(x, cells, rng)
        left = self._pad(x - self.cells[self.cell_of(x)]).reshape(len(x), -1, 2)
        self.centres = np.stack([self._means(left[:, m], 16, rng) for m in range(left.shape[1])])
        for _ in range(4):  # centres by weighted least squares for codes chosen under the anisotropic loss
            codes = self._codes(x)
            self._refit(x, codes)
        self.reach = np.quantile(np.linalg.norm(x - self.cells[self.cell_of(x)], axis=1), p.near_share)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - self.dim)))

    @staticmethod
    def _means(x: np.ndarray, k: int, rng) -> np.ndarray:
        centre = x[rng.choice(len(x), size=k, replace=len(x) < k)] + 1e-9 * rng.standard_normal((k, x.shape[1]))
        for _ in range(12):
            own = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            total = np.zeros_like(centre)
            np.add.at(total, own, x)
            count = np.bincount(own, minlength=k)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        return centre

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.cells.T - 0.5 * (self.cells**2).sum(1)).argmax(1)

    def _parts(self, x: np.ndarray):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        left = self._pad(x - self.cells[self.cell_of(x)])
        return left.reshape(len(x), -1, 2), self._pad(unit).reshape(len(x), -1, 2)

    def _codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent on |r|^2 + (w - 1) (r . x/|x|)^2 over one subspace's code at a time."""
        left, unit = self._parts(x)
        extra, rows = self.p.parallel_weight - 1, np.arange(len(x))
        codes = np.stack([((left[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(left.shape[1])], axis=1)
        error = np.stack([left[:, m] - self.centres[m][codes[:, m]] for m in range(left.shape[1])], axis=1)
        along = (error * unit).sum(2)
        for _ in range(sweeps):
            for m in range(left.shape[1]):
                option = left[:, m, None] - self.centres[m]
                option_along = np.einsum("nkd,nd->nk", option, unit[:, m])
                rest = along.sum(1) - along[:, m]
                codes[:, m] = ((option**2).sum(2) + extra * (rest[:, None] + option_along) ** 2).argmin(1)
                along[:, m] = option_along[rows, codes[:, m]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        left, unit = self._parts(x)
        extra = self.p.parallel_weight - 1
        error = np.stack([left[:, m] - self.centres[m][codes[:, m]] for m in range(left.shape[1])], axis=1)
        along = (error * unit).sum(2)
        for m in range(left.shape[1]):
            u = unit[:, m]
            rest = along.sum(1) - along[:, m] + (left[:, m] * u).sum(1)
            for k in range(16):
                own = codes[:, m] == k
                if own.any():
                    a = own.sum() * np.eye(2) + extra * u[own].T @ u[own]
                    b = left[own, m].sum(0) + extra * (u[own] * rest[own, None]).sum(0)
                    self.centres[m, k] = np.linalg.solve(a, b)
            along[:, m] = ((left[:, m] - self.centres[m][codes[:, m]]) * u).sum(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, its codes packed two a byte, the length of their error, and whether it lies near its cell's centre."""
        with np.errstate(all="ignore"):
            x = x / self.unit
            codes, cell = self._codes(x).astype(np.uint8), self.cell_of(x)
            left = self._pad(x - self.cells[cell]).reshape(len(x), -1, 2)
            error = np.sqrt(((left - self.centres[np.arange(left.shape[1]), codes]) ** 2).sum((1, 2)))
            near = np.sqrt((left**2).sum((1, 2))) <= self.reach
        return cell, codes[:, 0::2] | codes[:, 1::2] << 4, np.where(np.isnan(error), np.inf, error), near

    def order(self, q: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The cells ``known`` for each query, largest inner product first."""
        return known[np.argsort(-(q / self.unit @ self.cells[known].T), axis=1, kind="stable")]

    def probes(self, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, known: np.ndarray) -> int:
        """How many cells hold ``wanted`` of the nearest rows of the sample ``x`` for queries ``q``; rows far from centres are met anyway."""
        cell, _, _, near = self.encode(x)
        score = np.where(ids == q_ids[:, None], -np.inf, (q / self.unit) @ (x / self.unit).T)
        place = np.full((len(q), len(self.cells)), -1)
        np.put_along_axis(place, self.order(q, known), np.arange(len(known))[None, :], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(self.p.top, max(1, len(x) - 1))]
        needed = np.sort(np.where(near[best], np.take_along_axis(place, cell[best], axis=1), -1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(self.p.wanted * len(needed))) - 1)]) + 1

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what a byte of code adds to a query's score."""
        half = np.einsum("qmd,mkd->qmk", self._pad(q / self.unit).reshape(len(q), -1, 2), self.centres)
        low, high = half[:, 0::2], half[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), self.pairs, 256).astype(np.float32)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row: equal rows have equal ones wherever they stand."""
    return (x * q).sum(1)


def _floor(q_ids: np.ndarray, q: np.ndarray, visited: np.ndarray, ids: np.ndarray, x: np.ndarray, part: np.ndarray, top: int) -> np.ndarray:
    """What each query's last result has at least: the score of its ``top``-th row of the sample ``x`` in the cells it visits, a little less for rounding."""
    if len(x) <= top:
        return np.full(len(q), -np.inf)
    met = np.zeros((len(q), max(part.max(), visited.max(initial=0)) + 2), bool)  # the last place stands for part -1
    np.put_along_axis(met, visited, True, axis=1)
    met[:, -1] = True
    with np.errstate(all="ignore"):
        score = np.where((ids == q_ids[:, None]) | ~met[:, part], -np.inf, q @ x.T)
        low = np.partition(np.where(np.isnan(score), -np.inf, score), -top, axis=1)[:, -top]
        return low - 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()


def _scan(q_ids, q, floor, ids, x, cell, packed, error, book: Codebook) -> pd.DataFrame:
    """Best rows of one chunk for each query: tables first, then exact, then exactly what the error of a code leaves open."""
    p, out = book.p, []
    order = np.argsort(ids, kind="stable")
    ids, x, cell, packed, error = ids[order], x[order], cell[order], packed[order], error[order]
    for at in range(0, len(q), 64):
        asked = q[at : at + 64]
        with np.errstate(all="ignore"):
            tables, base = book.tables(asked), asked / book.unit @ book.cells.T
            score = base[:, cell].astype(np.float32)
            for byte in range(book.pairs):
                score += tables[:, byte][:, packed[:, byte]]
            slack = 1e-6 * (book.pairs + 2) * (np.abs(tables).max(2).sum(1) + np.abs(base).max(1))  # of single precision
            most = score + np.linalg.norm(asked / book.unit, axis=1)[:, None] * error * (1 + 1e-9) + slack[:, None]
            keep = np.argsort(-score, axis=1, kind="stable")[:, : p.rerank]
            for row, chosen in enumerate(keep):
                own, v = q_ids[at + row], asked[row]
                exact = np.where(ids[chosen] == own, -np.inf, _exact(x[chosen], v))
                if len(ids) > len(chosen):
                    last = max(floor[at + row], np.sort(exact)[-p.top] if len(exact) >= p.top else -np.inf)
                    open_ = ~(most[row] * book.unit**2 < last)  # rounding, infinities and what is no number stay open
                    open_[chosen] = False
                    more = np.flatnonzero(open_)
                    if len(more) > p.rerank:  # one product finds out which of many may matter
                        rough = x[more] @ v
                        size = np.linalg.norm(v) * np.linalg.norm(x[more], axis=1)
                        more = more[~(rough + 1e-12 * size < last)]
                    chosen, exact = np.r_[chosen, more], np.r_[exact, _exact(x[more], v)]
                other = (ids[chosen] != own) & ~(exact < floor[at + row])  # what is less is no result, wherever the query goes
                exact, mine = exact[other], ids[chosen][other]
                best = np.lexsort((mine, -exact))[: p.top]
                out.append(pd.DataFrame({"query_id": own, "vec_id": mine[best], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query, p: Search = Search(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the rows with the largest inner products found for each query row."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, key, column)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).toPandas()
    if sample.empty:
        return spark.createDataFrame([], empty)
    dim = int(sample["v"].map(len).mode()[0])
    sample = sample[sample["v"].map(len) == dim]
    x = np.stack([np.asarray(v, float) for v in sample["v"]])
    rows = rows.where(F.size("v") == dim)
    cells = min(max(1, rows.count() // p.rows_per_cell), p.most_cells)
    book = Codebook(x, cells, p)

    def encoded(frames):
        for frame in frames:
            if len(frame):
                full = np.stack(frame["v"].to_numpy()).astype(float)
                cell, packed, error, near = book.encode(full)
                yield frame.assign(cell=cell.astype("int32"), part=np.where(near, cell, -1).astype("int32"), code=[r.tobytes() for r in packed], error=error)

    held_index = "vec_id long, v array<double>, cell int, part int, code binary, error double"
    index = materialize(rows.mapInPandas(encoded, held_index), "ip-index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row a cell; -1 is what lies far from all
    chunks = {c: -(-n // p.chunk_rows) for c, n in sizes.items()}
    known = np.array(sorted(c for c in sizes if c >= 0), int)
    tried = index.where(is_query("vec_id")).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.trial).toPandas()
    if tried.empty:
        return spark.createDataFrame([], empty)
    measured = book.probes(tried["vec_id"].to_numpy(), np.stack(tried["v"].to_numpy()).astype(float), sample["vec_id"].to_numpy(), x, known)
    probes = min(len(known), max(p.least_probes, int(np.ceil(p.probe_share * cells)), measured))

    own_ids, first = np.unique(sample["vec_id"].to_numpy(), return_index=True)  # an id counts once
    nearest, _, _, close = book.encode(x[first])
    held_sample = spark.sparkContext.broadcast((own_ids, x[first], np.where(close, nearest, -1)))

    def routed(frames):
        for frame in (whole.iloc[at : at + 256] for whole in frames for at in range(0, len(whole), 256)):
            q = np.stack(frame["v"].to_numpy()).astype(float)
            near = book.order(q, known)[:, :probes]
            floor = _floor(frame["vec_id"].to_numpy(), q, near, *held_sample.value, p.top)
            at = [(i, c, k) for i, cs in enumerate(near) for c in (*cs, -1) for k in range(chunks.get(c, 0))]
            i, c, k = map(np.array, zip(*at))
            yield pd.DataFrame({"query_id": frame["vec_id"].to_numpy()[i], "q": frame["v"].to_numpy()[i], "floor": floor[i], "part": c.astype("int32"), "chunk": k.astype("int32")})

    asking = index.where(is_query("vec_id")).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = asking.mapInPandas(routed, "query_id long, q array<double>, floor double, part int, chunk int")
    count = F.element_at(F.create_map(*[F.lit(int(z)) for pair in chunks.items() for z in pair]), F.col("part"))
    dealt = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.col("v")), count).cast("int"))
    dealt = dealt.select("part", "chunk", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", "cell", "code", "error", F.lit(None).cast("double").alias("floor"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("cell", "int"), ("code", "binary"), ("error", "double"))]
    queries = asking.select("part", "chunk", F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"), *nothing, "floor")
    by = ["part", "chunk"]
    meeting = dealt.unionByName(queries).repartition(*by).sortWithinPartitions(*by, "asks")

    def scanned(frames):
        """Rows of a chunk are kept as they come, all before its first query."""
        at, rows, held = None, [], None
        for frame in frames:
            for key, part in frame.groupby(by, sort=True):
                if key != at:
                    at, rows, held = key, [], None
                own, asked = part[~part["asks"]], part[part["asks"]]
                if len(own):
                    rows.append(own)
                if not len(asked) or held is None and not rows:  # a chunk may have got no rows
                    continue
                if held is None:
                    whole = pd.concat(rows)
                    packed = np.frombuffer(b"".join(whole["code"]), np.uint8).reshape(len(whole), -1)
                    vectors = np.stack(whole["v"].to_numpy()).astype(float)
                    held, rows = (whole["id"].to_numpy(), vectors, whole["cell"].to_numpy().astype(int), packed, whole["error"].to_numpy(float)), []
                q = np.stack(asked["v"].to_numpy()).astype(float)
                yield _scan(asked["id"].to_numpy(), q, asked["floor"].to_numpy(float), *held, book)

    found = meeting.mapInPandas(scanned, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 20 == 0)
