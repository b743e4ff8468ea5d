"""Mixing sources to target weights, sized in tokens."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrain.functions.text import strip_blank
from findgrain.session import spread, through_table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The word pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 22
#: Longer texts are tokenised in pieces of about so many characters, which end where the word pattern ends a word anyway.
PIECE_CHARS = 100_000
#: Between these characters the pattern always ends a word: before a single blank, and after a letter before a mark.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[^\W\d_])(?=[^\w\s'])")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """A text in pieces short enough for the word pattern; all of it, in order, and with the tokens of the whole."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        m = _BOUNDARY.search(text, at + PIECE_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole text; null and empty texts have none. Special-token strings are ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return texts.map(lambda t: sum(len(encode(part)) for part in parts(t)) if t else 0).astype("int64")

    return count(text)


def source_key(c: Column) -> Column:
    return strip_blank(F.lower(c))


def sized_documents(documents: DataFrame, *, doc: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc, source, tokens)`` with the source trimmed and lower-cased; a null source stays null and belongs to no target."""
    rows = spread(documents.select(F.col(doc).alias("doc"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")))
    return rows.select("doc", "source", token_count(F.col("text"), tokenizer).alias("tokens"))


@dataclass(frozen=True)
class Source:
    """What a source offers: tokens, the share wanted of it, how often each of its documents may be used, and its documents with tokens."""

    name: str
    tokens: int
    target: float
    repeats: int
    documents: int = 0

    @property
    def cap(self) -> int:
        return self.tokens * max(0, self.repeats)


def entropy(weights: list[float]) -> float:
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights if w > 0) if total > 0 else 0.0


def temperature(tokens: list[int], exponent: float) -> list[float]:
    """Token shares raised to an exponent and normalised: 1 keeps them, 0 makes them equal. Sources without tokens keep 0."""
    top = max(tokens, default=0)
    raised = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised] if top else [0.0] * len(tokens)


def bisect_exponent(meets, low: float, high: float, grid: int = 160, steps: int = 60) -> float:
    """The greatest exponent between ``low`` and ``high`` for which ``meets`` holds; ``low`` if it holds nowhere.

    Under repetition limits ``meets`` may change more than once, so a grid finds the last change and bisection refines it.
    """
    at = [low + (high - low) * i / grid for i in range(grid + 1)]
    last = max((i for i, e in enumerate(at) if meets(e)), default=None)
    if last is None:
        return low
    if last == grid:
        return high
    low, high = at[last], at[last + 1]
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if meets(mid) else (low, mid)
    return low


def fill(limits: list[float], weights: list[float], amount: float) -> list[float]:
    """``amount`` dealt out by weights, each share held at its limit and what is left handed on to the others."""
    out, room = [0.0] * len(limits), {i for i, limit in enumerate(limits) if limit > 0 and weights[i] > 0}
    left = min(amount, sum(limits[i] for i in room))
    while left > 0.5 and room:
        whole = sum(weights[i] for i in room)
        full = {i for i in room if out[i] + left * weights[i] / whole >= limits[i]}
        if not full:
            for i in room:
                out[i] += left * weights[i] / whole
            break
        for i in full:
            left -= limits[i] - out[i]
            out[i] = limits[i]
        room -= full
    return out


@dataclass(frozen=True)
class Planned:
    source: Source
    weight: float
    budget: int


def plan_mix(sources: list[Source], total: int) -> list[Planned]:
    """Budgets in tokens of a mix as large as ``total``.

    Temperature: the token shares of all sources are raised to an exponent, which is bisected so that the mix comes to the entropy
    of the target shares, as near as the repetition limits allow. Of these weights a source gets at least its target share,
    or all it may give where that is less; what such sources leave open goes to the others by temperature again, under the
    same limits. If all sources together cannot fill the mix it is smaller than ``total``.
    """
    tokens, caps = [s.tokens for s in sources], [float(s.cap) for s in sources]
    least = [min(s.target * total, cap) for s, cap in zip(sources, caps)]

    def filled(exponent: float) -> list[float]:
        more = fill([c - b for c, b in zip(caps, least)], temperature(tokens, exponent), total - sum(least))
        return [b + m for b, m in zip(least, more)]

    aim = entropy([s.target for s in sources])
    exponent = bisect_exponent(lambda e: entropy(filled(e)) >= aim, 0.0, 8.0)
    budgets = filled(exponent)
    whole = sum(budgets) or 1.0
    # up to the next token, so that a source that can reach its share is not planned below it
    return [Planned(s, b / whole, min(s.cap, math.ceil(b - 1e-6))) for s, b in zip(sources, budgets)]


def read_sources(sized: DataFrame, targets: DataFrame) -> tuple[list[Source], int]:
    """The targets with the tokens they have, and the tokens of all documents. One row a target comes to the driver.

    Targets are compared like sources of documents. Of several rows for one source the greatest share counts; null shares
    and repeats are 0; a target without name is left out. Documents without id count in the total only.
    """
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max(F.struct("target", "repeats")).alias("w"))
    # tokenised once: the sums are read twice
    usable = F.col("doc").isNotNull() & (F.col("tokens") > 0)
    sums = [F.sum(F.when(usable, F.col("tokens"))).alias("tokens"), F.count_if(usable).alias("documents"), F.sum("tokens").alias("every")]
    per = through_table(sized.groupBy("source").agg(*sums), "source-tokens")
    # the total rides along as the row of no source
    all_rows = per.groupBy().agg(F.sum("every").alias("tokens"), F.sum("documents").alias("documents")).select(F.lit(None).cast("string").alias("source"), "tokens", "documents")
    per = per.drop("every")
    known = wanted.select("source").join(per, "source", "left")
    rows = known.unionByName(all_rows).join(wanted, "source", "left").collect()
    total = sum(r["tokens"] or 0 for r in rows if r["source"] is None)
    sources = [Source(r["source"], r["tokens"] or 0, r["w"]["target"], r["w"]["repeats"], r["documents"] or 0) for r in rows if r["source"] is not None]
    return sorted(sources, key=lambda s: s.name), total


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block in their permuted order, taken while they fit; one that does not is passed over."""
    pdf = pdf.sort_values(["order", "doc"], kind="stable")
    left, took = int(pdf["left"].iloc[0]), []
    for n in pdf["tokens"]:
        took.append(n <= left)
        left -= n if took[-1] else 0
    return pdf.assign(took=took)[["doc", "source", "tokens", "passes", "took"]]


def realise(sized: DataFrame, plan: list[Planned], *, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc, source, tokens, copies)``: how often each document is used; documents not used, and those without tokens, are left out.

    A budget of so many whole passes gives every document that many copies. The rest of a budget is a partial pass: the documents
    of a source are dealt into blocks of about ``block_tokens``, blocks are taken in a permuted order while they fit,
    and of the first that does not fit, documents in a permuted order, each that still fits. Only sums of blocks are ordered per source,
    and only one block's documents per source are gathered: each has a token at least. The same seed gives the same mix.
    """
    spark = sized.sparkSession
    rows = [
        (p.source.name, p.budget // p.source.tokens, p.budget % p.source.tokens, max(1, -(-p.source.tokens // block_tokens)))
        for p in plan
        if p.source.tokens > 0 and p.budget > 0
    ]
    budgets = spark.createDataFrame(rows, "source string, passes long, rest long, blocks long")
    docs = sized.where("doc is not null and tokens > 0").select("doc", "source", "tokens").join(F.broadcast(budgets), "source")
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("blocks")))
    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    upto = sums.withColumn("block_end", F.sum("block_tokens").over(order)).join(F.broadcast(budgets.select("source", "rest")), "source")
    state = upto.select(
        "source",
        "block",
        (F.col("rest") - F.col("block_end") + F.col("block_tokens")).alias("left"),
        (F.col("block_end") <= F.col("rest")).alias("whole"),
    ).where("left > 0")
    placed = docs.join(state, ["source", "block"], "left")
    split = F.coalesce(~F.col("whole"), F.lit(False))
    kind = dict(docs.dtypes)["doc"]
    edge = placed.where(split).withColumn("order", F.xxhash64("doc", F.lit(seed + 1))).select("doc", "source", "tokens", "passes", "left", "order")
    edge = edge.groupBy("source").applyInPandas(_greedy, f"doc {kind}, source string, tokens long, passes long, took boolean")
    rest = placed.where(~split).select("doc", "source", "tokens", "passes", F.coalesce("whole", F.lit(False)).alias("took"))
    used = edge.unionByName(rest).withColumn("copies", F.col("passes") + F.col("took").cast("long"))
    return used.where("copies > 0").select("doc", "source", "tokens", "copies")


def actual_shares(mix: DataFrame, plan: list[Planned], total: int) -> DataFrame:
    """``(source, target_share, planned_share, tokens, actual_share, max_copies, reachable)``: what the mix really holds of each target.

    A source is not reachable if its tokens in the mix are below its share of ``total`` though each of its documents is there as often as it may be.
    """
    spark = mix.sparkSession
    planned = spark.createDataFrame(
        [(p.source.name, p.source.target, p.weight, p.source.target * total, p.source.documents, max(0, p.source.repeats)) for p in plan],
        "source string, target_share double, planned_share double, wanted double, documents long, repeats long",
    )
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies"), F.sum("copies").alias("uses"))
    out = planned.join(per, "source", "left").fillna(0, ["tokens", "max_copies", "uses"])
    # one row a target in this window
    whole = F.sum("tokens").over(Window.partitionBy())
    short = (F.col("tokens") < F.col("wanted")) & (F.col("uses") >= F.col("documents") * F.col("repeats"))
    return out.select("source", "target_share", "planned_share", "tokens", (F.col("tokens") / F.nullif(whole, F.lit(0))).alias("actual_share"), "max_copies", (~short).alias("reachable"))
