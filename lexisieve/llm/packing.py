"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents of more than `size` tokens are cut into pieces of `size`, the first
of which may be shorter; full pieces fill a sequence each.  The rest is dealt
into shards of bounded size.  Best fit packs each shard; where that takes more
bins than the lower bound, ceil(tokens / size), the bins that are not full, and
some of many documents that are, are opened to evolution.  Genes are whole
bins: crossover injects well-filled bins of one parent into another, removes
the bins that held the same documents, swaps displaced documents into other
bins where they leave less room, and puts the rest back by best fit; mutation
empties the worst bins and some others and fills them anew, each as full as the
documents at hand can (sums of lengths as bits of one integer).

A shard has several islands, each with a population of its own and each a
group of the cluster's: an epoch is one shuffle, which hands every island its
population and the elite of the island before it.  The best of all islands is
the shard's packing.  Between two passes the bins that are nearly full stay and
the documents of the others migrate to fewer, newly dealt shards, so that at
most the last pass leaves a bin per shard badly filled.

Only identifiers and lengths are shuffled, never token ids.

Defined results: a null text counts as empty and is the end token alone; rows
of equal doc_id are packed as documents of their own; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.llm import arrays as A
from lexisieve.llm.pretokens import worker_encoder
from lexisieve.llm.spark_utils import persist_table

SHARD = 4000  # pieces packed together
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 4, 2, 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "id long, length long, shard long, bin int, fill int, open int"
STATE = "shard long, island int, bins int, evenness double, plan binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def model_encoder(tokenizer_json: str):
    """Encodes one pre-token with the model of a byte-level tokenizers file."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def one(text: str) -> list[int]:
        return [t.id for t in model.tokenize("".join([letters[b] for b in text.encode()]))]

    return one


def cut(n: int, size: int) -> list[int]:
    """Starts of the pieces of n tokens, and n."""
    head = n % size or size
    return [0, *range(head, n + 1, size)] if n > size else [0, n]


def _tokenise(tokenizer_json: str, end: int, size: int):
    name = f"{zlib.crc32(tokenizer_json.encode())}-model"

    def run(batches):
        encoder = worker_encoder(name, lambda: model_encoder(tokenizer_json))
        for batch in batches:
            doc, text = batch.columns
            for i, j in A.pieces(text, 2 << 20):
                ids, off = encoder.encode(text.slice(i, j - i))
                rows, out = [], []
                for r in range(j - i):
                    own = np.append(ids[off[r] : off[r + 1]], end).astype("<u4")
                    at = cut(len(own), size)
                    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        rows.append(i + r)
                        out.append((k, a, b - a, zlib.crc32(own[a:b].tobytes())))
                k, a, n, crc = zip(*out, strict=True)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([doc.take(take), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """A packing: bins of item numbers, and the bins by the room they have left."""

    def __init__(self, length: list[int], size: int):
        self.length, self.size = length, size
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def _file(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.mask |= 1 << r

    def add(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.size - sum([self.length[i] for i in items]))
        self._file(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Puts items, longest first, each into the fullest bin that has room for it."""
        length = self.length
        for i in sorted(items, key=length.__getitem__, reverse=True):
            need = length[i]
            fits = self.mask >> need
            if not fits:
                self.add([i])
                continue
            r = need + (fits & -fits).bit_length() - 1
            bucket = self.by_room[r]
            b = bucket.pop()
            if not bucket:
                self.mask &= ~(1 << r)
            self.bins[b].append(i)
            self.room[b] = r - need
            self._file(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; among equals, the more uneven the fill the better."""
        return -len(self.bins), sum([((self.size - r) / self.size) ** 2 for r in self.room])


def swap_in(length: list[int], size: int, bins: list[list[int]], free: list[int]) -> list[int]:
    """Replaces one or two items of a bin by one of the free ones where that leaves less room; the items free afterwards."""
    free = sorted(free, key=length.__getitem__)
    sizes = [length[i] for i in free]
    for items in bins:
        room = size - sum([length[i] for i in items])
        if not room or not free:
            continue
        gain, out, at = 0, (), 0
        for x, i in enumerate(items):
            for pair in ((i,), *[(i, k) for k in items[:x]]):
                had = sum([length[k] for k in pair])
                place = bisect_right(sizes, had + room) - 1
                if place >= 0 and sizes[place] - had > gain:
                    gain, out, at = sizes[place] - had, pair, place
        if gain:
            items[:] = [i for i in items if i not in out] + [free.pop(at)]
            del sizes[at]
            for i in out:
                place = bisect_right(sizes, length[i])
                sizes.insert(place, length[i])
                free.insert(place, i)
    return free


def fullest(length: list[int], size: int, items: list[int]) -> list[int]:
    """The longest of items (which come longest first) and the others that fill its bin best, long ones rather than short ones."""
    mask = (1 << (size - length[items[0]] + 1)) - 1
    sums = [1]  # of the first k others: bit t is set if some of them make t
    for i in items[1:]:
        sums.append((sums[-1] | sums[-1] << length[i]) & mask)
    left, out = sums[-1].bit_length() - 1, [items[0]]
    for k in range(len(items) - 1, 0, -1):
        if not sums[k - 1] >> left & 1:
            out.append(items[k])
            left -= length[items[k]]
    return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """A child of a with some of b's well-filled bins injected; displaced documents are swapped in or best-fitted."""
    order = sorted(range(len(b.bins)), key=b.room.__getitem__)
    top = order[: max(1, len(order) // 2)]
    injected = [list(b.bins[k]) for k in rng.sample(top, max(1, len(top) // 2))]
    taken = {i for items in injected for i in items}
    kept, displaced = [], []
    for items in a.bins:
        if taken.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    displaced = swap_in(a.length, a.size, kept, displaced)
    child = Bins(a.length, a.size)
    for items in kept + injected:
        child.add(items)
    child.best_fit(displaced)
    return child


def mutate(a: Bins, rng: random.Random, share: int = 20) -> Bins:
    """A copy of a whose worst bins, one of `share`, and as many others were emptied and filled anew, each as full as it gets."""
    order = sorted(range(len(a.bins)), key=a.room.__getitem__, reverse=True)
    n = min(len(order), max(2, len(order) // share))
    gone = set(order[:n]) | set(rng.sample(order, n))
    child = Bins(a.length, a.size)
    for k, items in enumerate(a.bins):
        if k not in gone:
            child.add(list(items))
    free = sorted([i for k in gone for i in a.bins[k]], key=a.length.__getitem__, reverse=True)
    while free:
        items = fullest(a.length, a.size, free)
        child.add(items)
        taken = set(items)
        free = [i for i in free if i not in taken]
    return child


def packed_bins(length: list[int], size: int, plan: list[int]) -> Bins:
    """The packing that puts item i into bin plan[i]."""
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(plan):
        bins.setdefault(b, []).append(i)
    out = Bins(length, size)
    for b in sorted(bins):
        out.add(bins[b])
    return out


def first_population(seed: Bins, rng: random.Random) -> list[Bins]:
    return [seed, *[mutate(seed, rng, 4) for _ in range(POPULATION - 1)]]


def generations(population: list[Bins], target: int, rng: random.Random, n: int) -> list[Bins]:
    """The population after n children, or as soon as one has `target` bins; a child takes the place of the worst."""
    population = list(population)
    for _ in range(n):
        if len(population) < 2 or min(len(p.bins) for p in population) <= target:
            break
        a, b = rng.sample(population, 2)
        child = crossover(a, b, rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        worst = min(range(len(population)), key=lambda k: population[k].fitness())
        if child.fitness() > population[worst].fitness():
            population[worst] = child
    return population


def _seed(size: int):
    """The pieces of one shard -> their bins by best fit, and which are open to evolution."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending")])
        length = table.column("length").to_pylist()
        full = sum(n == size for n in length)
        rest = Bins(length, size)
        rest.best_fit(list(range(full, len(length))))
        bins = [[i] for i in range(full)] + rest.bins
        room = [0] * full + rest.room
        opened: set[int] = set()
        if len(rest.bins) > -(-sum(length[full:]) // size):
            opened = {b for b, r in enumerate(room) if r}
            perfect = sorted((b for b, r in enumerate(room) if not r and len(bins[b]) > 1), key=lambda b: (-len(bins[b]), b))
            opened |= set(perfect[: len(opened) // 2])
        n = len(length)
        number, fill, is_open = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for b, items in enumerate(bins):
            number[items], fill[items], is_open[items] = b, size - room[b], b in opened
        return pa.table({"id": table.column("id"), "length": table.column("length"), "shard": pa.array([key[0].as_py()] * n, pa.int64()), "bin": pa.array(number), "fill": pa.array(fill), "open": pa.array(is_open)})

    return run


def _items(table: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
    """The open pieces of one shard in their fixed order, their lengths and their bins by best fit."""
    table = table.sort_by([("length", "descending"), ("id", "ascending")])
    return table, table.column("length").to_pylist(), table.column("bin").to_pylist()


def _plan(bins: Bins) -> bytes:
    out = np.zeros(len(bins.length), np.int32)
    for b, items in enumerate(bins.bins):
        out[items] = b
    return out.tobytes()


def _epoch(size: int, number: int):
    """One island's pieces and population (its own and a migrant) -> its next population, and its elite for the next island."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, state: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        _, length, seed = _items(table)
        rng = random.Random(f"{shard}:{island}:{number}")
        plans = sorted(zip(state.column("bins").to_pylist(), state.column("evenness").to_pylist(), state.column("plan").to_pylist(), strict=True), key=lambda x: (x[0], -x[1], x[2]))
        population = [packed_bins(length, size, np.frombuffer(p, np.int32).tolist()) for _, _, p in plans[:POPULATION]]
        if not population:
            population = first_population(packed_bins(length, size, seed), rng)
        population = generations(population, -(-sum(length) // size), rng, GENERATIONS)
        elite = max(population, key=Bins.fitness)
        rows = [(island, p) for p in population] + [((island + 1) % ISLANDS, elite)]
        return pa.table({
            "shard": pa.array([shard] * len(rows), pa.int64()),
            "island": pa.array([i for i, _ in rows], pa.int32()),
            "bins": pa.array([len(p.bins) for _, p in rows], pa.int32()),
            "evenness": pa.array([p.fitness()[1] for _, p in rows]),
            "plan": A.binaries([_plan(p) for _, p in rows]),
        })

    return run


def _settle(size: int):
    """One shard's pieces by best fit and its best plan for the open ones -> the shard's packing, open pieces in bins of their own numbers."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, best: pa.Table) -> pa.Table:
        table = table.append_column("at", pa.array(np.arange(len(table))))
        number, fill = table.column("bin").to_numpy().copy(), table.column("fill").to_numpy().copy()
        is_open = table.column("open").to_numpy() > 0
        if len(best):
            part, length, _ = _items(table.filter(pa.array(is_open)))
            plan, at = np.frombuffer(best.column("plan")[0].as_py(), np.int32), part.column("at").to_numpy()
            number[at] = plan + (number.max() + 1)
            fill[at] = np.bincount(plan, weights=length)[plan]
        out = {c: table.column(c) for c in ("id", "length", "shard")}
        return pa.table(out | {"bin": pa.array(number, pa.int32()), "fill": pa.array(fill, pa.int32()), "open": pa.array(is_open.astype(np.int32))})

    return run


def evolved(pieces: DataFrame, shards: int, salt: int, size: int) -> DataFrame:
    """(id, length, shard, bin, fill, open) of pieces (id, length), dealt into shards and packed."""
    dealt = pieces.select("id", "length").withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(shards)))
    seeds = persist_table(dealt.groupBy("shard").applyInArrow(_seed(size), PACKED), "packing-seeds")
    items = seeds.where("open = 1").select("id", "length", "shard", "bin", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    state = seeds.sparkSession.createDataFrame([], STATE)
    for epoch in range(EPOCHS):
        state = persist_table(items.groupBy("shard", "island").cogroup(state.groupBy("shard", "island")).applyInArrow(_epoch(size, epoch), STATE), "packing-state")
    best = state.groupBy("shard").agg(F.min_by("plan", F.struct("bins", F.negate("evenness"), "plan")).alias("plan"))
    return seeds.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_settle(size), PACKED)


def tokenised(docs: DataFrame, tokenizer_json: str, end: int = 2, size: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tokenise(tokenizer_json, end, size), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, size: int = 1024, nearly: float = 0.998) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text by the tokenizers file at `tokenizer`,
    without special tokens, then `end`.  Pieces are numbered once and for all
    as their table is written, and dealt by that number.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        pieces = persist_table(tokenised(docs, f.read(), end, size).withColumn("id", F.monotonically_increasing_id()), "packing-pieces")
    first = persist_table(evolved(pieces, max(1, pieces.count() // SHARD), 1, size), "packing-first")
    loose = first.where(F.col("fill") < nearly * size)
    second = evolved(loose, max(1, loose.count() // SHARD), 2, size)
    both = first.where(F.col("fill") >= nearly * size).withColumn("pass", F.lit(0)).unionByName(second.withColumn("pass", F.lit(1)))
    sequence = (F.col("shard") * 2 + F.col("pass")) * (1 << 24) + F.col("bin")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("id")) - F.col("length")
    placed = both.select("id", "length", sequence.alias("sequence_id")).withColumn("offset", before).select("id", "sequence_id", "offset")
    return pieces.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
