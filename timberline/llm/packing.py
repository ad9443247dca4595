"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.common import read_table, spread

LENGTH = 2048
END_ID = 1
#: Tokens that are packed together; more than this in a task start another unit, so memory is bounded.
UNIT = 2 << 20
#: Room beyond the tokens, as a share: more of it cuts fewer documents and pads more.
SLACK = 0.02
#: Words whose ids a worker keeps, at most twice: those met of late, and as many met before them.
CACHE = 125_000


def piece_cost(n: int, linear: float = 1.0, square: float = 1.0 / LENGTH) -> float:
    """Estimated cost of a piece of n tokens: feed-forward work in n, attention in its square."""
    return linear * n + square * n * n


def rooms_for(total: int, length: int = LENGTH, slack: float = SLACK) -> list[int]:
    """Capacities of the sequences that ``total`` tokens go to: as many whole ones as hold them and ``slack`` more, so that most
    documents find one with room; where rounding up would pad over twice that, whole ones and one for each power of
    two in the rest, so that nothing is padded."""
    whole = -(-int(total * (1 + slack)) // length)
    if whole * length - total <= 2 * slack * whole * length:
        return [length] * whole
    return [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if (total % length) >> b & 1]


def pack_unit(lengths: list[int], length: int = LENGTH, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(document, start, n, sequence, offset) of each piece, for documents of the given lengths.

    What of a document fills sequences whole has them to itself. The rest go by descending length, each to the sequence of
    least cost among those with room for it. Only where none has room is a document cut: as much as the roomiest holds
    goes there, the remainder takes its turn by its length.
    """
    todo, out, full = [], [], 0
    for d, n in enumerate(lengths):
        for a in range(0, n - length + 1, length):
            out.append((d, a, length, full, 0))
            full += 1
        if n % length:
            todo.append((-(n % length), d, n - n % length))
    size = np.array(rooms_for(-sum(t[0] for t in todo), length, slack), dtype=np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    heapq.heapify(todo)
    while todo:
        n, d, a = heapq.heappop(todo)
        s = int(np.where(room >= -n, cost, np.inf).argmin())
        if room[s] < -n:
            s = int(room.argmax())
        take = min(-n, int(room[s]))
        out.append((d, a, take, full + s, int(size[s] - room[s])))
        room[s] -= take
        cost[s] += piece_cost(take)
        if take < -n:
            heapq.heappush(todo, (n + take, d, a + take))
    return out


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases, cuts at white space and keeps letters apart from the rest.

    Words (cut at spaces and line feeds only) are remembered. A new word of plain letters and closing points goes to the
    tokenizer's model alone, which skips what its normaliser and patterns would do to no effect; any other
    goes through all of it.
    """

    POINTS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.cores, self.old, self.old_cores = {}, {"": b""}, {}, {}
        self.model = self.tokenizer.model
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin letters that lower-case one to one and never compose, as the model's byte alphabet shows them.
        self.letters = {c: shown.pre_tokenize_str(c.lower())[0][0] for c in map(chr, range(0x41, 0x130)) if c.isalpha()}

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, word: str) -> bytes:
        core = word.rstrip(self.POINTS)
        try:
            shown = "".join([self.letters[c] for c in core])
        except KeyError:
            return self._whole(word)
        out = self.cores.get(shown)
        if out is None:
            out = self.old_cores.get(shown)
            if out is None:
                out = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.cores[shown] = out
        if len(core) < len(word):
            tail = word[len(core) :]
            if tail not in self.cores:
                self.cores[tail] = self._whole(tail)
            out += self.cores[tail]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        if len(self.cores) > CACHE:
            self.cores, self.old_cores = {"": b""}, self.cores
        known, before = self.known, self.old.get
        for w in {w for ws in words for w in ws if w not in known}:
            ids = before(w)
            known[w] = self._new(w) if ids is None else ids
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") for ws in words]


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document in sequences of ``length`` tokens; with_ids adds each piece's ids.

    Tasks pack their own documents, a unit of at most UNIT tokens (or one document) at a time, so nothing is shuffled
    and a lost task packs the same again. A unit's thousand sequences balance as well as more would. sequence_id is
    the partition's number times 2**32 plus a count, so which documents share a sequence goes with how the input is split:
    another cluster or file layout packs otherwise, as fully. A null or empty text is end_id alone; a very long text is a
    unit of its own; rows with one doc_id, and equal rows, are packed each on its own; ties in length go by the order of
    rows; extra columns are ignored; an empty table gives no pieces.
    """

    def run(batches):
        from pyspark import TaskContext

        ids_of = WordIds(path)
        base, done = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        names: list = []

        def flush():
            nonlocal done
            pieces = pack_unit([len(x) for x in ids], length)
            cols: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            raw = []
            for d, a, n, s, o in pieces:
                part = ids[d][a : a + n]
                for c, v in zip(cols.values(), (names[d], a, n, zlib.crc32(part), len(ids[d]), base + done + s, o)):
                    c.append(v)
                if with_ids:
                    raw.append(part.astype(np.int32))
            done += 1 + max((s for _, _, _, s, _ in pieces), default=-1)
            ids.clear()
            names.clear()
            arrays = [pa.array(v, pa.int64()) for v in cols.values()]
            for i in range(0, len(pieces), 20_000):
                part = [x.slice(i, 20_000) for x in arrays]
                yield pa.RecordBatch.from_arrays(part + ([pa.array(raw[i : i + 20_000], pa.list_(pa.int32()))] if with_ids else []), [*cols, *["ids"] * with_ids])

        held = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                for name, own in zip(some.column(0).to_pylist(), ids_of(some.column(1).to_pylist())):
                    own = np.append(own, np.uint32(end_id))
                    if held and held + len(own) > UNIT:
                        yield from flush()
                        held = 0
                    ids.append(own)
                    names.append(name)
                    held += len(own)
        if held:
            yield from flush()

    return spread(docs, ["doc_id", "text"]).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir):
    """Pieces of all documents."""
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
