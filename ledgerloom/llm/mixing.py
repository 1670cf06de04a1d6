"""Mixing sources to target weights by Poisson replication (p7)."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Folder of the tokenizer files; a parameter everywhere, this is its default.
TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
#: Public word pattern of the byte-level tokenizers, used with .tiktoken files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bins of the uniform numbers in which the tokens of a source are summed to set its rate; sources x BINS rows reach the driver at most.
BINS = 4096


@lru_cache(maxsize=4)
def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a tokenizer file: .tiktoken ranks, a tokenizers .json, or a sentencepiece .model. Special tokens' strings count as plain text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def with_token_counts(documents: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str) -> DataFrame:
    """(id_col, *keep, fingerprint, n_tokens): the sizes and a 128-bit fingerprint of the texts; null texts have neither. One pass over the texts, which go no further."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *keep]) + ", fingerprint string, n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for batch in batches:
            known = batch[text_col].notna()
            out = batch[[id_col, *keep, "fingerprint"]].copy()
            out["n_tokens"] = pd.array([None] * len(batch), dtype="Int64")
            if known.any():
                out.loc[known, "n_tokens"] = count(batch.loc[known, text_col].tolist())
            yield out

    return documents.select(id_col, *keep, text_col, F.md5(F.col(text_col)).alias("fingerprint")).mapInPandas(run, schema)


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k = 0 .. cap - 1: a uniform number reaches as many of the steps as the count of the Poisson variable, up to cap."""
    if rate == float("inf"):
        return [0.0] * cap
    term = exp(-rate)
    total, out = term, []
    for k in range(cap):
        out.append(total)
        term *= rate / (k + 1)
        total += term
    return out


def solve_rate(bins: dict[int, int], cap: int, wanted: float, n_bins: int = BINS) -> float:
    """The Poisson rate at which the capped counts use `wanted` tokens, given the tokens by bin of the uniform number. A want of cap x all tokens has the rate infinity."""
    whole = sum(bins.values())
    if wanted <= 0 or not whole:
        return 0.0
    if wanted >= cap * whole:
        return float("inf")

    def used(rate: float) -> float:
        total = 0.0
        for step in poisson_steps(rate, cap):
            edge = step * n_bins
            cut = int(edge)
            total += sum(n for b, n in bins.items() if b > cut) + bins.get(cut, 0) * (1 - (edge - cut))
        return total

    low, high = 0.0, 1.0
    while used(high) < wanted and high < 700:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if used(mid) < wanted else (low, mid)
    return high


class Mixture:
    """Documents of several sources, each repeated so that the sources reach their target shares of all tokens.

    documents: id_col, text_col, source_col; targets: source, target_share, max_repeats (a fixed or bounded table, at most `max_sources` rows). Documents of other or null sources,
    and null texts or texts of no token, take no part. Copies of one text under several ids are one text: the smallest id stands for it, in its source, so no text is used more than
    max_repeats times in all. Shares are of the tokens used; a share of 0 or a max_repeats of 0 takes nothing. A source without documents has the share 0, and the others keep their
    proportions. Empty input gives an empty mixture.

    Each text has a uniform number from a hash of its fingerprint and the seed; its count is the inverse of a Poisson distribution at that number, cut at max_repeats. The rate of a source is
    set so that its counts use share x total tokens. total is `fill` times the tokens at which the tightest source would use every text max_repeats times, so the counts of that source
    are drawn too; or total_tokens, beyond which sources run out and the reported shares differ from the targets. Documents are exploded by their counts and ordered by a hash.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", seed: int = 7, total_tokens: float | None = None, fill: float = 0.9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 10_000):
        self.spark = documents.sparkSession
        if not 0 < fill <= 1:
            raise ValueError("fill is above 0 and at most 1")
        self.scratch = Scratch(self.spark, "mixing")
        self.id_col, self.seed = id_col, seed
        rows = targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        self.targets = {r.source: (float(r.target_share), int(r.max_repeats)) for r in rows}
        mine = F.broadcast(self.spark.createDataFrame([(s,) for s in self.targets], "source string"))
        part = documents.select(F.col(id_col), F.col(text_col), F.col(source_col).alias("source")).filter(F.col(text_col).isNotNull()).join(mine, "source", "left_semi")
        sized = self.scratch.cut(with_token_counts(part, id_col, text_col, ["source"], tokenizer).filter("n_tokens > 0"))
        owner = sized.groupBy("fingerprint").agg(F.min(F.struct(id_col, "source", "n_tokens")).alias("m"))
        # a uniform number from 52 bits of a hash that any engine has
        uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "fingerprint")), 1, 13), 16, 10).cast("double") / float(1 << 52)
        self.texts = self.scratch.cut(owner.select(f"m.{id_col}", "m.source", "m.n_tokens", "fingerprint", uniform.alias("u")))
        # at most sources x BINS rows
        binned = self.texts.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).collect()
        bins: dict[str, dict[int, int]] = {s: {} for s in self.targets}
        for r in binned:
            bins[r.source][r.bin] = r.n
        held = {s: sum(b.values()) for s, b in bins.items()}
        room = [held[s] * cap / share for s, (share, cap) in self.targets.items() if held[s]]
        share_there = sum(share for s, (share, _) in self.targets.items() if held[s]) or 1.0
        total = total_tokens / share_there if total_tokens is not None else fill * min(room, default=0.0)
        self.rates = {s: solve_rate(bins[s], cap, share * total) for s, (share, cap) in self.targets.items()}
        self.held = held

    def counted(self) -> DataFrame:
        """(id_col, source, n_tokens, fingerprint, repeats): every text that could take part, with its uses, 0 too."""
        steps = self.spark.createDataFrame([(s, poisson_steps(self.rates[s], self.targets[s][1])) for s in self.targets], "source string, steps array<double>")
        reached = F.size(F.filter("steps", lambda x: x <= F.col("u")))
        return self.texts.join(F.broadcast(steps), "source").select(self.id_col, "source", "n_tokens", "fingerprint", reached.alias("repeats"))

    def mixed(self) -> DataFrame:
        """(id_col, source, n_tokens, repeat, place): one row for each use of a text; place is its random place, and the rows are globally in that order."""
        used = self.counted().filter("repeats > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), "repeats")))
        placed = used.withColumn("place", F.md5(F.concat(F.lit(f"{self.seed}/"), "fingerprint", F.lit("/"), F.col("repeat").cast("string"))))
        return placed.select(self.id_col, "source", "n_tokens", "repeat", "place").repartitionByRange("place").sortWithinPartitions("place")

    def shares(self) -> DataFrame:
        """Per target source: target_share, share, tokens used and held, texts used and held, most uses of one text."""
        own = self.counted().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.sum("n_tokens").alias("tokens_held"), F.sum((F.col("repeats") > 0).cast("bigint")).alias("texts_used"), F.count(F.lit(1)).alias("texts_held"), F.max("repeats").alias("most_repeats")
        )
        all_targets = self.spark.createDataFrame([(s, share, cap) for s, (share, cap) in self.targets.items()], "source string, target_share double, max_repeats int")
        joined = all_targets.join(own, "source", "left").fillna(0, ["tokens_used", "tokens_held", "texts_used", "texts_held", "most_repeats"])
        total = own.agg(F.sum("tokens_used").alias("all_tokens"))
        return joined.join(F.broadcast(total), how="left").select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), F.col("all_tokens")), F.lit(0.0)).alias("share"), "max_repeats", "most_repeats", "tokens_used", "tokens_held", "texts_used", "texts_held")
