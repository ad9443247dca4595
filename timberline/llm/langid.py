"""Language identification by prediction by partial matching: frozen byte context trees, exact code lengths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import read_table, sampled, spread

#: Contexts hold up to so many bytes.
ORDER = 3
#: Documents of a language that the trees are grown from, about. All of their texts count.
SAMPLE = 1500
#: Bytes that are taken at once; parts overlap by the context, so nothing is lost between them.
PART = 1 << 18
#: Bytes whose grams a task counts at once; rows that are judged at once.
COUNTED, ROWS = 1 << 21, 512
PAD = b"\n" * ORDER
UNKNOWN = "und"


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Each byte with the k before it, as a number; data begins with ORDER bytes of padding."""
    out = np.zeros(len(data) - ORDER, dtype=np.uint32)
    for i in range(k, -1, -1):
        out = (out << np.uint32(8)) | data[ORDER - i : len(data) - i]
    return out


@dataclass
class ContextTrees:
    """For each order k: keys, the sorted grams that some language's tree has, and cost, bits of the last byte after the
    others for each (key, language); contexts, the sorted contexts that some tree has, and escape, bits of leaving each.

    A byte costs, after the longest context of k bytes that a tree has, log2((n + d) / c), where c of the context's n
    bytes were this one and d differ; where none was, log2((n + d) / d), and the cost after a byte less of context
    (escape method C without exclusions). Below order 0 each byte costs 8 bits. Costs are resolved when the
    statistics are frozen: a gram's row has the whole cost in every language, escapes included.
    """

    langs: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def grown(cls, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]) -> ContextTrees:
        """counts: for each language and order, sorted grams and how often each occurs."""
        langs = sorted(counts)
        own = cls(langs, [], [], [], [])
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([counts[g][k][0] for g in langs]))
            contexts = np.unique(keys >> np.uint32(8))
            escape = np.zeros((len(contexts), len(langs)))
            cost = own._back_off(keys & np.uint32(2 ** (8 * k) - 1), k - 1)
            for j, g in enumerate(langs):
                grams, c = counts[g][k]
                at, inverse = np.unique(grams >> np.uint32(8), return_inverse=True)
                n, d = np.bincount(inverse, c), np.bincount(inverse)
                escape[np.searchsorted(contexts, at), j] = np.log2((n + d) / d)
                cost[:, j] += escape[np.searchsorted(contexts, keys >> np.uint32(8)), j]
                cost[np.searchsorted(keys, grams), j] = np.log2((n + d)[inverse] / c)
            for x, v in zip((own.keys, own.cost, own.contexts, own.escape), (keys, cost, contexts, escape)):
                x.append(v)
        return own

    def _back_off(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Bits of grams of order k in each language."""
        if k < 0:
            return np.full((len(grams), len(self.langs)), 8.0)
        at = np.minimum(np.searchsorted(self.keys[k], grams), len(self.keys[k]) - 1)
        out = self.cost[k][at]
        new = np.flatnonzero(self.keys[k][at] != grams)
        if len(new):
            g = grams[new]
            out[new] = self._back_off(g & np.uint32(2 ** (8 * k) - 1), k - 1)
            c = np.minimum(np.searchsorted(self.contexts[k], g >> np.uint32(8)), len(self.contexts[k]) - 1)
            seen = self.contexts[k][c] == g >> np.uint32(8)
            out[new[seen]] += self.escape[k][c[seen]]
        return out

    def index(self) -> None:
        """A hash table from a gram of four bytes to its row: open addressing, at most a quarter full, so that its size goes
        with the number of grams alone."""
        keys = self.keys[ORDER]
        self.bits = max(8, (4 * len(keys) - 1).bit_length())
        self.row = np.full(1 << self.bits, -1, dtype=np.int32)
        self.key = np.zeros(1 << self.bits, dtype=np.uint32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.row[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            self.row[at] = todo[free][first]
            left = self.row[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (len(self.row) - 1)
        used = self.row >= 0
        self.key[used] = keys[self.row[used]]
        self.top = self.cost[ORDER].astype(np.float32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Each gram's row, -1 where no tree has it."""
        slot = self._slot(grams)
        out = self.row[slot]
        off = np.flatnonzero((out >= 0) & (self.key[slot] != grams))
        slot = slot[off]
        while len(off):
            slot = (slot + 1) & (len(self.row) - 1)
            out[off] = self.row[slot]
            on = (out[off] >= 0) & (self.key[slot] != grams[off])
            off, slot = off[on], slot[on]
        return out

    def code_lengths(self, texts: list[bytes], part: int = PART) -> np.ndarray:
        """Bits of each whole text in each language. Long texts go through in parts, which lose no context."""
        out = np.zeros((len(texts), len(self.langs)))
        for i, t in enumerate(texts):
            data = np.frombuffer(PAD + t, dtype=np.uint8)
            for a in range(0, len(t), part):
                out[i] += self._bits(data[a : a + part + ORDER])
        return out

    def _bits(self, data: np.ndarray) -> np.ndarray:
        grams = _grams(data, ORDER)
        rows = self.rows_of(grams)
        hit = rows >= 0
        n = np.bincount(rows[hit], minlength=0) if len(rows) > 4 * len(self.top) else None
        total = n @ self.top[: len(n)] if n is not None else self.top[rows[hit]].sum(axis=0, dtype=np.float64)
        if not hit.all():
            total = total + self._back_off(grams[~hit], ORDER).sum(axis=0)
        return total


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2


def train(docs: DataFrame, where: Column, sample: int = SAMPLE) -> ContextTrees | None:
    """Trees from the whole texts of about ``sample`` documents of each language among those that meet ``where``, picked by a
    hash of their ids.

    Grams are counted by task, a part of a text at a time, and added up by language in Spark; what comes to the driver is
    the distinct grams of the sample. Languages are the model's classes: it holds a column for each, so labels that are not
    languages (thousands of them) don't belong in lang. Only text and lang teach. None if no document has a language.
    """
    docs = spread(docs, ["doc_id", "text", "lang"]).where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return None
    least = F.lit(False)
    for s in set(share.values()):
        least = least | (F.col("lang").isin([k for k, v in share.items() if v == s]) & sampled("doc_id", s))
    picked = docs.where(least).select("lang", "text")

    def count(batches):
        for b in batches:
            parts: dict[str, list[np.ndarray]] = {}
            held = 0
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = np.frombuffer(PAD + text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for a in range(0, len(data) - ORDER, PART):
                    parts.setdefault(lang, []).append(data[a : a + PART + ORDER])
                    held += len(parts[lang][-1])
                    if held >= COUNTED:
                        yield from counted(parts)
                        parts, held = {}, 0
            yield from counted(parts)

    def counted(parts):
        for lang, texts in parts.items():
            for k in range(ORDER + 1):
                g, n = np.unique(np.concatenate([_grams(t, k) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(np.full(len(g), k, dtype=np.int32)), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "k", "g", "n"])

    rows = picked.mapInArrow(count, "lang string, k int, g bigint, n bigint").groupBy("lang", "k", "g").agg(F.sum("n").alias("n")).toArrow()
    lang, k, g, n = (rows.column(c).to_numpy() for c in ("lang", "k", "g", "n"))
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for name in set(lang):
        for o in range(ORDER + 1):
            at = (lang == name) & (k == o)
            order = np.argsort(g[at])
            counts.setdefault(name, {})[o] = (g[at][order].astype(np.uint32), n[at][order].astype(float))
    counts = {name: c for name, c in counts.items() if all(len(c[o][0]) for o in c)}
    return ContextTrees.grown(counts) if counts else None


def identify(docs: DataFrame, trees: ContextTrees | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs, with lang_pred and score: the language of the shortest code, and its share if each
    language had probability 2**-bits.

    Texts that are null or have no letter, and all texts where nothing was learnt, are "und" with score 0.
    Every row is judged by its whole text alone; extra columns are ignored.
    """
    docs = docs.select(*keep) if keep else spread(docs, ["doc_id", "text"])
    if trees is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample
    names = docs.columns
    place = names.index("text")

    def run(batches):
        model = shared.value
        if not hasattr(model, "top"):
            model.index()
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = b.column(place).to_pylist()
            known = np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
            pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if known.any():
                bits = model.code_lengths([t.encode("utf-8", "surrogatepass") for t, ok in zip(texts, known) if ok])
                best = bits.argmin(axis=1)
                pred[known] = np.array(model.langs, dtype=object)[best]
                score[known] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(run, schema)


def op4_langid(spark, sf_dir):
    """Every document's language, by trees of the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = ~learnable(F.col("doc_id"))
    return identify(docs, train(docs, learnable(F.col("doc_id")))).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
