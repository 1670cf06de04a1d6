"""Evaluation texts that leak into training text, by suffix arrays of the training side (p6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

WORD = re.compile(r"[^\W_]+")

#: Words of training text in one shard's suffix array; longer texts are several shards.
SHARD_WORDS = 1_000_000
#: Words of test items that are on the driver and in every task at once; more items are searched block by block against the same suffix arrays.
BLOCK_WORDS = 500_000


def word_list(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` (or more) ids, by prefix doubling; ids are not negative."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) if n else ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def _search(text: np.ndarray, order: np.ndarray, heads: np.ndarray, right: bool) -> np.ndarray:
    """For each row of heads (the first ids of a test suffix) the place among the sorted training suffixes, all by binary search at once."""
    low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(order), np.int64)
    width = heads.shape[1]
    padded = np.concatenate((text, np.full(width, -1, text.dtype)))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        rows = np.flatnonzero(open_)
        mid = (low[rows] + high[rows]) // 2
        at = padded[order[mid][:, None] + np.arange(width)]
        want = heads[rows]
        differs = at != want
        first = differs.argmax(1)
        some = differs.any(1)
        less = some & (at[np.arange(len(rows)), first] < want[np.arange(len(rows)), first])
        down = less | (~some if right else np.zeros(len(rows), bool))
        low[rows[down]] = mid[down] + 1
        high[rows[~down]] = mid[~down]


def _extend(text: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Lengths of the common runs at the hits, which share `length` words already. Both sides end in values that match nothing."""
    run = np.full(len(at), length, np.int64)
    live = np.arange(len(at))
    while len(live):
        same = text[at[live] + run[live]] == test[start[live] + run[live]]
        live = live[same]
        run[live] += 1
    return run


class Shards:
    """Some whole texts as one array of word numbers, each text closed by a 0, with suffix arrays over stretches of at most shard_words."""

    def __init__(self, docs: list, words: list[list[str]], min_run: int, shard_words: int):
        vocabulary: dict[str, int] = {}
        number = vocabulary.setdefault
        flat: list[int] = []
        begins = []
        for mine in words:
            begins.append(len(flat))
            flat.extend([number(w, len(vocabulary) + 1) for w in mine])
            flat.append(0)
        self.docs, self.begins, self.text, self.vocabulary = docs, np.array(begins, np.int64), np.array(flat, np.int32), vocabulary
        # a suffix belongs to the stretch in which it starts; the stretch is read on so far that its order is known
        self.orders = [(at, suffix_array(self.text[at : at + shard_words + min_run - 1].astype(np.int64), min_run)) for at in range(0, len(flat), shard_words)]
        self.orders = [(order[order < shard_words] + at).astype(np.int32 if len(flat) < 1 << 31 else np.int64) for at, order in self.orders]

    def search(self, block: tuple, min_run: int) -> tuple[np.ndarray, ...] | None:
        """(text, item, run, place in the text, place in the item) as row numbers: of each text and item the longest run, the first in the text, then in the item."""
        starts, words_of = block
        get = self.vocabulary.get
        test = np.array([get(w, -2) if w is not None else -3 for w in words_of], np.int64)
        if len(test) < min_run:
            return None
        # test suffixes whose first min_run words all occur here; those that cross an item's end do not
        known = np.concatenate(([0], np.cumsum(test > 0)))
        suffix = np.arange(len(test) - min_run + 1)
        suffix = suffix[known[suffix + min_run] - known[suffix] == min_run]
        if not len(suffix):
            return None
        heads = test[suffix[:, None] + np.arange(min_run)]
        text, closed = np.append(self.text, -4), np.append(test, -5)
        out = []
        for order in self.orders:
            low, high = _search(self.text, order, heads, False), _search(self.text, order, heads, True)
            counts = high - low
            if not counts.sum():
                continue
            which = np.repeat(np.arange(len(suffix)), counts)
            at = order[np.repeat(low, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))].astype(np.int64)
            run = _extend(text, at, closed, suffix[which], min_run)
            doc = np.searchsorted(self.begins, at, "right") - 1
            item = np.searchsorted(starts, suffix[which], "right") - 1
            out.append((doc, item, run, at - self.begins[doc], suffix[which] - starts[item]))
        if not out:
            return None
        doc, item, run, doc_at, item_at = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((item_at, doc_at, -run, item, doc))
        first = np.ones(len(order), bool)
        first[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
        keep = order[first]
        return doc[keep], item[keep], run[keep], doc_at[keep], item_at[keep]

    def row(self) -> dict:
        return {"begins": self.begins.tobytes(), "words": self.text.tobytes(), "orders": [o.astype(np.int64).tobytes() for o in self.orders], "vocabulary": list(self.vocabulary)}

    @classmethod
    def of_row(cls, docs: list, row) -> Shards:
        out = cls.__new__(cls)
        out.docs, out.begins, out.text = docs, np.frombuffer(row["begins"], np.int64), np.frombuffer(row["words"], np.int32)
        out.vocabulary = {w: k + 1 for k, w in enumerate(row["vocabulary"])}
        out.orders = [np.frombuffer(o, np.int64) for o in row["orders"]]
        return out


def _in_shards(batches: Iterator[pd.DataFrame], id_col: str, text_col: str, min_run: int, shard_words: int) -> Iterator[Shards]:
    docs, held, n = [], [], 0
    for batch in batches:
        for i, text in zip(batch[id_col], batch[text_col], strict=True):
            words = word_list(text)
            if len(words) < min_run:
                continue
            if held and n + len(words) > shard_words:
                yield Shards(docs, held, min_run, shard_words)
                docs, held, n = [], [], 0
            docs.append(i)
            held.append(words)
            n += len(words)
    if held:
        yield Shards(docs, held, min_run, shard_words)


def _hits(shards: Shards, block, min_run: int, id_col: str) -> Iterator[pd.DataFrame]:
    ids, *rest = block.value
    found = shards.search(rest, min_run)
    if found is not None:
        doc, item, run, doc_at, item_at = found
        yield pd.DataFrame({id_col: [shards.docs[d] for d in doc], "item_id": ids[item], "run_words": run, "doc_word": doc_at, "item_word": item_at})


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_run: int = 12, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id_col, item_id, run_words, doc_word, item_word): each pair of a document and an item that share a run of at least min_run consecutive words, with the longest
    such run and where it starts (the first in the document, then in the item).

    Words are maximal runs of letters or digits, lower-cased. The documents are cut into shards of `shard_words` words, each with a suffix array in the order of the first min_run words; every
    suffix of every item is found in it by binary search, and each hit is followed to its end, beyond the shard too. Items go to the tasks in blocks of about
    `block_words` words, so any number of them is searched against all documents: with one block the arrays are searched where they are built; with more they are
    built once, kept as a table, and each block is searched in them and its hits written before the next block is read. Null and short texts match nothing; repeated ids are searched each
    and give repeated rows; either side empty gives an empty table; other columns are ignored.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, item_id bigint, run_words bigint, doc_word bigint, item_word bigint"
    sized = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    total = sized.agg(F.coalesce(F.sum(F.size(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}]+)"), 1))), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // block_words))

    def block(part: int):
        """The items of one block: the driver holds no more than one at a time."""
        rows = sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        ids, starts, flat = [], [], []
        for r in sorted(rows, key=lambda r: (r.i, r.t)):
            ids.append(r.i)
            starts.append(len(flat))
            flat.extend(word_list(r.t))
            flat.append(None)
        return spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(starts, np.int64), flat)) if ids else None

    if parts == 1:
        held = block(0)
        if held is None:
            return spark.createDataFrame([], schema)

        def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for shards in _in_shards(batches, id_col, text_col, min_run, shard_words):
                yield from _hits(shards, held, min_run, id_col)

        out = documents.select(id_col, text_col).mapInPandas(at_once, schema)
    else:
        scratch = Scratch(spark, "suffix-arrays")

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for shards in _in_shards(batches, id_col, text_col, min_run, shard_words):
                yield pd.DataFrame([{"docs": shards.docs, **shards.row()}])

        arrays = scratch.cut(documents.select(id_col, text_col).mapInPandas(build, f"docs array<{kind}>, begins binary, words binary, orders array<binary>, vocabulary array<string>"))
        out = spark.createDataFrame([], schema)
        for part in range(parts):
            held = block(part)
            if held is None:
                continue

            def of_block(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for row in batch.to_dict("records"):
                        yield from _hits(Shards.of_row(list(row["docs"]), row), held, min_run, id_col)

            out = out.unionByName(scratch.cut(arrays.mapInPandas(of_block, schema)))
            held.unpersist()
        scratch.drop(arrays)
    # an item id with several rows, or rows of one id in different shards: the longest run counts
    best = F.max(F.struct("run_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return out.groupBy(id_col, "item_id").agg(best).select(id_col, "item_id", "m.run_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def leaked_items(leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(item_id, n_documents, longest_run) of the items that leaked."""
    return leaks.groupBy("item_id").agg(F.countDistinct(id_col).alias("n_documents"), F.max("run_words").alias("longest_run"))


def without_leaks(documents: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that hold a leaked passage."""
    return documents.join(leaks.select(id_col).distinct(), id_col, "left_anti")
