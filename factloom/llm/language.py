"""Language identification by prediction by partial matching over bytes.

Every language has a frozen context tree of orders ``ORDER`` to 0, learned from labelled texts. A byte is coded in
the longest known context; where it was not seen there, an escape is coded (as many escape counts as distinct bytes)
and the next shorter context takes over, without the bytes already excluded. Below order 0 all bytes left are alike.
The language with the shortest code for the whole text wins.

Costs of all byte strings seen in training are resolved beforehand into one table, so a text is scored by
table lookups; unseen strings are resolved when they occur. The labelled rows may be a bounded sample (``MOST_ROWS`` per
language), of which all strings and all languages count. Where they are too many for one table, groups of languages have
tables of their own, which texts pass one after the other.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
learned; ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash as H
from factloom.llm.common import bounded_sample
from factloom.session import cut_lineage

ORDER = 3
MOST_ROWS = 4_000
#: Costs that a model holds, one for each of its strings and languages.
CELLS = 32_000_000
UNKNOWN = "und"


def strings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte, itself and the ``ORDER`` bytes before it as one number; zero bytes stand before a text."""
    code = data.astype(np.uint32)
    heads = offsets[:-1][np.diff(offsets) > 0]
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[: max(len(data) - back, 0)]
        for k in range(back):
            before[heads[heads + k < len(data)] + k] = 0
        code |= before << np.uint32(8 * back)
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        for first, data, offsets in H.slices(batch.column("text")):
            code = strings(data, offsets).astype(np.int64)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            keys, n = np.unique((which[first + row].astype(np.int64) << 32) | code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[keys >> 32].tolist(), pa.string()), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["lang", "code", "n"]
            )


class Tree:
    """One language's counts; ``cost`` gives code lengths in bits."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.keys, self.counts, self.contexts, self.totals, self.kinds = [], [], [], [], []
        self.less_totals, self.less_kinds = [], []
        for order in range(ORDER + 1):
            mask = np.int64((1 << 8 * (order + 1)) - 1)
            keys, at = np.unique(code & mask, return_inverse=True)
            counts = np.bincount(at, n)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.totals.append(np.bincount(of, counts))
            self.kinds.append(np.bincount(of).astype(float))
        for order in range(ORDER):  # what is left of a context once the bytes of the longer one are excluded
            mask = np.int64((1 << 8 * (order + 1)) - 1)
            longer, above = self.contexts[order + 1], self.keys[order + 1]
            of = np.searchsorted(longer, above >> 8)
            taken = np.bincount(of, self.counts[order][np.searchsorted(self.keys[order], above & mask)], len(longer))
            suffix = np.searchsorted(self.contexts[order], longer & np.int64((1 << 8 * order) - 1))
            self.less_totals.append(self.totals[order][suffix] - taken)
            self.less_kinds.append(self.kinds[order][suffix] - self.kinds[order + 1])

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return at, sorted_keys[at] == wanted

    def cost(self, code: np.ndarray) -> np.ndarray:
        code = code.astype(np.int64)
        bits = np.zeros(len(code))
        open_ = np.arange(len(code))
        longer = np.full(len(code), -1)  # number of the known longer context, of the open ones
        for order in range(ORDER, -1, -1):
            own = code[open_] & np.int64((1 << 8 * (order + 1)) - 1)
            context, known = self._find(self.contexts[order], own >> 8)
            total, kinds = self.totals[order][context], self.kinds[order][context]
            if order < ORDER:
                after = longer >= 0
                total = np.where(after, self.less_totals[order][longer], total)
                kinds = np.where(after, self.less_kinds[order][longer], kinds)
            at, seen = self._find(self.keys[order], own)
            coded = known & (kinds > 0)
            size = np.where(coded, total + kinds, 1.0)
            hit = coded & seen
            bits[open_[hit]] += np.log2(size[hit] / self.counts[order][at[hit]])
            missed = coded & ~seen
            bits[open_[missed]] += np.log2(size[missed] / kinds[missed])
            open_, longer = open_[~hit], np.where(known, context, -1)[~hit]
        bits[open_] += np.log2(256 - self.kinds[0][0])
        return bits


class Model:
    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees
        if not trees:
            return
        seen = np.unique(np.concatenate([t.keys[ORDER] for t in trees]))
        self.bits = np.stack([t.cost(seen) for t in trees], axis=1).astype(np.float32)
        # bytes are numbered; three bytes lead to a row, the fourth to the string's place in ``bits``
        alphabet = np.unique(np.concatenate([(seen >> 8 * k) & 255 for k in range(ORDER + 1)]))
        self.letter = np.full(256, len(alphabet), np.int64)
        self.letter[alphabet] = np.arange(len(alphabet))
        self.size = len(alphabet) + 1
        context, row = np.unique(self._context(seen), return_inverse=True)
        self.rows = np.full(self.size**ORDER, len(context), np.int32)
        self.rows[context] = np.arange(len(context))
        self.places = np.full((len(context) + 1) * self.size, -1, np.int32)
        self.places[row * self.size + self.letter[seen & 255]] = np.arange(len(seen))

    def _context(self, code: np.ndarray) -> np.ndarray:
        out = self.letter[(code >> 24) & 255]
        for k in (2, 1):
            out = out * self.size + self.letter[(code >> 8 * k) & 255]
        return out

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row under every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        code = strings(data, offsets)
        place = self.places[self.rows[self._context(code)] * np.int64(self.size) + self.letter[data]]
        bits = self.bits[place]
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            kinds, at = np.unique(code[unseen], return_inverse=True)
            bits[unseen] = np.stack([t.cost(kinds) for t in self.trees], axis=1)[at]
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out


def _groups(sizes: list[tuple[str, int]], cells: int) -> list[list[str]]:
    """Languages in order, cut so that a group's strings times its languages stay within ``cells``."""
    groups: list[list[str]] = []
    strings_ = 0
    for name, n in sizes:
        if not groups or (strings_ + n) * (len(groups[-1]) + 1) > cells:
            groups.append([])
            strings_ = 0
        groups[-1].append(name)
        strings_ += n
    return groups


def train(docs: DataFrame, *, most_rows: int = MOST_ROWS, cells: int = CELLS) -> list[Model]:
    """Learn from docs (doc_id, text, lang), all languages and all strings of the rows; rows without text or lang are left out.

    Languages are learned in groups whose tables have at most ``cells`` entries, or one language where it alone has more.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = bounded_sample(rows, "doc_id", "lang", most_rows)
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, code bigint, n bigint")
    counts = cut_lineage(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "strings")
    sizes = [(r["lang"], r["count"]) for r in counts.groupBy("lang").count().orderBy("lang").collect()]  # a row per language
    models = []
    for names in _groups(sizes, cells):
        found = counts.filter(F.col("lang").isin(names)).toPandas()  # bounded by cells
        parts = dict(tuple(found.groupby("lang")))
        models.append(Model(names, [Tree(parts[x]["code"].to_numpy(np.int64), parts[x]["n"].to_numpy(float)) for x in names]))
    return models


_LETTERS = H.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])


_STATE = "struct<lang:string,bits:double,rest:double>"


def _improved(text: Column, known: Column, model: Model) -> Column:
    """The best language of ``model`` and of those ``known`` before, its bits, and the sum of all probabilities over its own."""

    @F.arrow_udf(_STATE)
    def predict(texts: pa.Array, before: pa.Array) -> pa.Array:
        names, all_bits, all_rest = [], [], []
        strings_ = H.as_strings(texts)
        known_lang = before.field("lang").to_pylist()
        known_bits = before.field("bits").to_numpy(zero_copy_only=False).astype(float)
        known_rest = before.field("rest").to_numpy(zero_copy_only=False).astype(float)
        for first, data, offsets in H.slices(strings_):
            n = len(offsets) - 1
            inside = np.concatenate([[0], np.cumsum(_LETTERS[data])])
            letters = inside[offsets[1:]] > inside[offsets[:-1]]
            for k in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
                letters[k] = any(c.isalpha() for c in strings_[first + k].as_py())
            bits = model.costs(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(n), best]
            power = lambda x: np.exp2(-np.minimum(x, 1000))
            rest = power(bits - least[:, None]).sum(axis=1)
            was, was_rest = known_bits[first : first + n], known_rest[first : first + n]
            better = np.isnan(was) | (least < was)
            low = np.where(better, least, was)
            fresh = np.isnan(was)
            total = rest * power(least - low) + np.where(fresh, 0.0, was_rest) * power(np.where(fresh, low, was) - low)
            names += [(model.languages[b] if new else old) if ok else None for b, new, old, ok in zip(best.tolist(), better.tolist(), known_lang[first : first + n], letters.tolist())]
            all_bits.append(low)
            all_rest.append(total)
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), join(all_bits), join(all_rest)], ["lang", "bits", "rest"])

    return predict(text, known)


def identify(rows: DataFrame, text: str, models: list[Model], out: str = "language") -> DataFrame:
    """``rows`` and a struct ``out`` of the language and its share of the probability of the text.

    Several models are applied one after the other, each over a written table, so no worker holds more than one.
    """
    state = F.lit(None).cast(_STATE)
    for number, model in enumerate(models):
        rows = rows.withColumn(out, _improved(F.col(text), state, model))
        if number < len(models) - 1:
            rows = cut_lineage(rows, "languages")
        state = F.col(out)
    found = F.col(f"{out}.lang") if models else F.lit(None).cast("string")
    score = F.when(found.isNotNull(), 1 / F.col(f"{out}.rest")).otherwise(0.0) if models else F.lit(0.0)
    return rows.withColumn(out, F.struct(F.coalesce(found, F.lit(UNKNOWN)).alias("lang"), score.alias("score")))
