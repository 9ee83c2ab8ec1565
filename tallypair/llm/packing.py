"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pieces of a block, which one packing covers; islands that search it; epochs between which elites migrate.
BLOCK, ISLANDS, EPOCHS = 8192, 2, 2
#: Individuals of an island, and children an epoch.
POPULATION, CHILDREN = 4, 8
#: Of a bin's room the part that may stay empty before its documents are dealt to another block, and the
#: share of a block's bins, the emptiest, that are dealt so at most.
OPEN, MOST_OPEN = 1 / 128, 1 / 16
#: Words, and pieces of them, that a worker remembers (up to twice as many), and the longest of them.
REMEMBERED, LONGEST = 250_000, 40
#: Long texts are encoded so many characters at a time.
SLICE = 1 << 20
PIECES = "pos long, doc_id long, piece int, start long, length long, ids_crc32 long"

#: Fixed value: how the vocabulary splits a word of lower-case Latin-1 letters.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff]+|[0-9]|[^a-z\xe0-\xf6\xf8-\xff0-9]+").findall
#: Words of printable ASCII and Latin-1 letters: no other normal form, one lower case a letter. The
#: library parts words at a sharp s, so words with it are left to it.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xde\xe0-\xf6\xf8-\xff]+").fullmatch
_encoders: dict[str, Encoder] = {}


class Remembering(dict):
    """A function's values by text; short texts are remembered. When they are many, those that weren't met
    since the last such time are forgotten."""

    def __init__(self, function: Callable[[str], bytes]):
        super().__init__()
        self.function, self.before = function, {}

    def __missing__(self, said: str) -> bytes:
        out = self.before.get(said)
        if out is None:
            out = self.function(said)
        if len(said) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[said] = out
        return out


class Encoder:
    """A word's ids as little-endian 32-bit integers, by the vocabulary file of a word-end byte-pair model.

    White space separates tokens and is dropped, so a text's ids are its words' ids one after the other.
    Plain words go piece by piece to the library's model, all others to the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(others) for b in range(256)}
        self.pieces, self.words = Remembering(self._piece), Remembering(self._word)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if PLAIN(word) and len(word) < 1000 and not self.special(word):
            return b"".join(map(self.pieces.__getitem__, SPLIT(word.lower())))
        ids = self.library.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            end = len(text) if end >= len(text) or (end := text.find(" ", end)) < 0 else end
            words = text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(self.words.__getitem__, words)))
            at = end
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, room: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """``pos, doc_id, piece, start, length, ids_crc32`` (and ``ids``): each document's ids and then ``end``, cut
    into pieces of ``room``, as a table in the shared folder. ``pos`` tells all pieces apart."""
    last = struct.pack("<I", end)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.ids(text.as_py() or "") + last
                for k, a in enumerate(range(0, len(ids), 4 * room)):
                    cut = ids[a : a + 4 * room]
                    rows.append((doc, k, a // 4, len(cut) // 4, zlib.crc32(cut), *[np.frombuffer(cut, np.int32)] * with_ids))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kind = PIECES.removeprefix("pos long, ") + ", ids array<int>" * with_ids
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
    return written(cut.select(F.monotonically_increasing_id().alias("pos"), *names), "token-pieces")


class Bins:
    """A packing: each piece's bin, and each bin's room left, sought by a bit a room."""

    def __init__(self, length: list[int], room: int, where: np.ndarray | None = None):
        self.length, self.room = length, room
        self.where = np.full(len(length), -1, np.int32) if where is None else where.copy()
        self.left: list[int] = []
        if where is not None and len(where):
            used = np.bincount(where[where >= 0], weights=np.asarray(length)[where >= 0], minlength=int(where.max()) + 1)
            self.left = (room - used).astype(int).tolist()

    def place(self, pieces: list[int]) -> None:
        """Each piece, in their order, into the open bin that it fills best, else into a new one."""
        slots: list[list[int]] = [[] for _ in range(self.room + 1)]
        mask, left, where, length, room = 0, self.left, self.where, self.length, self.room
        for b, r in enumerate(left):
            if 0 < r < room:
                slots[r].append(b)
                mask |= 1 << r
        for p in pieces:
            n = length[p]
            if fits := mask >> n:
                r = n + (fits & -fits).bit_length() - 1
                b = slots[r].pop()
                if not slots[r]:
                    mask ^= 1 << r
            else:
                b, r = len(left), room
                left.append(room)
            where[p] = b
            left[b] = r = r - n
            if r:
                slots[r].append(b)
                mask |= 1 << r

    def tidy(self) -> Bins:
        """Bins without pieces go."""
        self.where = np.unique(self.where, return_inverse=True)[1].astype(np.int32)
        return Bins(self.length, self.room, self.where)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then fuller full ones: the squares of the fills."""
        return -len(self.left), sum((self.room - r) ** 2 for r in self.left)

    def settled(self) -> bool:
        """No packing has fewer bins, and nothing is left open but in one bin."""
        return not self.left or sum(self.left) - max(self.left) == 0


def crossover(one: Bins, other: Bins, rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of ``other`` come into ``one``; its bins that hold a document of theirs go, as
    that document is there now, and so does its least filled one; the displaced documents are placed
    best-fit, longest first."""
    left = np.array(other.left)
    likely = np.argsort(left + rng.random(len(left)), kind="stable")[: max(1, len(left) // 2)]
    chosen = np.zeros(len(left), bool)
    chosen[rng.choice(likely, max(1, int(len(likely) * rng.uniform(0.02, 0.12))), replace=False)] = True
    injected = chosen[other.where]
    gone = np.zeros(len(one.left), bool)
    gone[one.where[injected]] = True
    weak = np.argsort(-np.array(one.left), kind="stable")[:2]
    gone[weak] = True
    displaced = np.flatnonzero(gone[one.where] & ~injected)
    where = one.where.copy()
    where[gone[one.where]] = -1
    number = np.cumsum(~gone) - 1
    where[where >= 0] = number[where[where >= 0]]
    extra = np.cumsum(chosen) - 1
    where[injected] = int((~gone).sum()) + extra[other.where[injected]]
    child = Bins(one.length, one.room, where)
    length = np.asarray(one.length)[displaced]
    child.place(displaced[np.argsort(-length * rng.uniform(1, 1.15, len(length)) if rng.random() < 0.5 else -length, kind="stable")].tolist())
    return child.tidy()


def evolve(length: list[int], room: int, population: list[np.ndarray], seed: tuple[int, ...], size: int = POPULATION, children: int = CHILDREN) -> list[Bins]:
    """An island's next population, best first. An empty one starts with best fit of the longest first and
    of that order disturbed. Ends at once where the best can't be bettered."""
    rng = np.random.default_rng(seed)
    all_of, own = np.asarray(length), [Bins(length, room, p) for p in population]
    while len(own) < size and not (own and own[0].settled()):
        new = Bins(length, room)
        new.place(np.argsort(-all_of * rng.uniform(1, 1.0 + 0.1 * len(own), len(all_of)), kind="stable").tolist())
        own.append(new)
    own.sort(key=Bins.fitness, reverse=True)
    for _ in range(children):
        if own[0].settled():
            break
        a, b = sorted(rng.choice(len(own), 2, replace=False)) if len(own) > 1 else (0, 0)
        own.append(crossover(own[a], own[b], rng))
        own.sort(key=Bins.fitness, reverse=True)
        del own[size:]
    return own


ISLAND = "block long, island int, pos binary, length binary, population array<binary>, bins int, fill double, settled boolean"


def _island(block: int, island: int, pos: bytes, length: np.ndarray, own: list[Bins]) -> pa.Table:
    bins, fill = own[0].fitness()
    row = ([block], [island], [pos], [length.astype(np.int32).tobytes()], [[b.where.tobytes() for b in own]], [-bins], [float(fill)], [own[0].settled()])
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.float64(), pa.bool_())
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "island", "pos", "length", "population", "bins", "fill", "settled"])


def _first(room: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = table["block"][0].as_py(), table["island"][0].as_py()
        pos, length = table["pos"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(pos)
        pos, length = pos[order], length[order]
        return _island(block, island, pos.tobytes(), length, evolve(length.tolist(), room, [], (level, block, island, 0)))

    return run


def _next(room: int, level: int, epoch: int):
    """The neighbour's elite takes the place of the island's worst."""

    def run(own: pa.Table, guests: pa.Table) -> pa.Table:
        row, guest = own.to_pylist()[0], guests["elite"][0].as_py()
        if row["settled"]:
            return own
        length = np.frombuffer(row["length"], np.int32)
        population = [np.frombuffer(p, np.int32) for p in [*row["population"][: POPULATION - 1], guest]]
        return _island(row["block"], row["island"], row["pos"], length, evolve(length.tolist(), room, population, (level, row["block"], row["island"], epoch)))

    return run


def _places(room: int, last: bool):
    """A block's best packing as rows: a bin's number is its smallest ``pos``. The emptiest bins, if more than
    the share ``OPEN`` of their room is left, are open (sequence null), but for those of the last block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pos, length, where = np.frombuffer(row["pos"], np.int64), np.frombuffer(row["length"], np.int32).astype(np.int64), np.frombuffer(row["where"], np.int32)
                order = np.lexsort((pos, where))
                pos, length, where = pos[order], length[order], where[order]
                first = np.concatenate([[True], where[1:] != where[:-1]])
                starts = np.flatnonzero(first)
                size = np.diff(starts, append=len(where))
                offset = np.cumsum(length) - length
                offset -= np.repeat(offset[starts], size)
                left = room - np.add.reduceat(length, starts)
                emptiest = np.argsort(-left, kind="stable")[: 1 + int(len(left) * MOST_OPEN)]
                open_bins = np.zeros(len(left), bool)
                open_bins[emptiest] = left[emptiest] > room * OPEN
                full = np.repeat(~open_bins, size) | last
                number = pa.array(np.repeat(pos[starts], size), mask=~full)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(length), number, pa.array(offset)], ["pos", "length", "sequence_id", "offset"])

    return run


def _deal(blocks: int, level: int):
    """Pieces to blocks, each batch's by turns in the order of their lengths, so that blocks get alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(pos):
                rng = np.random.default_rng((level, int(pos[0])))
                block = np.empty(len(pos), np.int64)
                block[np.lexsort((rng.random(len(pos)), length))] = (np.arange(len(pos)) + rng.integers(blocks)) % blocks
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], ["pos", "length", "block"])

    return run


def packed(loose: DataFrame, room: int = 4096, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pos, sequence_id, offset`` of pieces ``pos, length`` (a written table), each shorter than ``room``.

    Pieces are dealt to blocks by their lengths in turn. Each block's islands evolve packings of it, a task an
    island; between epochs elites go round the block's islands. The documents of bins that stay open are
    dealt anew to the fewer blocks of the next level, until one block is left or a level closes few.
    """
    spark, closed, level = loose.sparkSession, [], 0
    there = loose.select("pos", "length")
    count = there.count()
    while count:
        blocks = -(-count // block)
        deal = there.mapInArrow(_deal(blocks, level), "pos long, length long, block long")
        deal = deal.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        tasks = max(1, min(blocks * islands, int(spark.conf.get("spark.sql.shuffle.partitions")) + blocks * islands // 16))
        state = written(deal.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(_first(room, level), ISLAND), f"islands-{level}-0")
        for epoch in range(1, epochs):
            if not state.where("not settled").limit(1).count():
                break
            elites = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("elite"))
            own, guests = (x.repartition(tasks, "block", "island").groupBy("block", "island") for x in (state, elites))
            state = written(own.cogroup(guests).applyInArrow(_next(room, level, epoch), ISLAND), f"islands-{level}-{epoch}")
        order = F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))
        best = state.groupBy("block").agg(F.max_by(F.struct("pos", "length", F.col("population")[0].alias("where")), order).alias("best")).select("best.*")
        last = blocks == 1
        places = written(best.mapInArrow(_places(room, last), "pos long, length long, sequence_id long, offset long"), f"places-{level}")
        again = places.where("sequence_id is null")
        left = again.count()
        if left > count // 2:  # too few close: their bins stay as they are
            places = written(best.mapInArrow(_places(room, True), "pos long, length long, sequence_id long, offset long"), f"places-{level}")
            left = 0
        closed.append(places.where("sequence_id is not null").select("pos", "sequence_id", "offset"))
        there, count, level = again.select("pos", "length"), left, level + 1
    out = closed[0] if closed else spark.createDataFrame([], "pos long, sequence_id long, offset long")
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, room: int = 4096, end: int = 1, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): documents' ids under the
    vocabulary file ``path``, each document closed by ``end``, packed into sequences of at most ``room``.

    Only documents longer than ``room`` are cut; pieces of ``room`` are sequences of their own, all others
    are packed. One or more rows per input row; a null or empty text is the id ``end`` alone. Null and
    repeated ids are packed like others, equal rows too. An empty table gives no rows; other columns are
    ignored. The same files give the same packing.
    """
    pieces = token_pieces(docs, path, room, end, with_ids)
    own = pieces.where(F.col("length") >= room).withColumns({"sequence_id": F.col("pos"), "offset": F.lit(0).cast("long")})
    loose = pieces.where(F.col("length") < room)
    return own.unionByName(loose.join(packed(loose, room, block), "pos")).drop("pos")
