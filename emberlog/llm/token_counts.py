"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is that of a sentencepiece BPE model with byte fallback.  Every
adjacent pair of symbols whose concatenation is a piece is on a heap, ordered by
the piece's rank and then by position; the lowest is merged until none is left.
Only the number of symbols is kept: no identifier is ever looked up or emitted.

No piece has a word mark after another character, so a text falls apart at each
space into segments that never merge with each other; a segment's count is kept
in a bounded table, since most segments recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Segments whose counts one Python worker keeps (about 100 bytes each).
KEPT_SEGMENTS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter(dict):
    """Counts of segments; a segment that is not kept yet is merged."""

    def __init__(self, model_path: str, kept: int = KEPT_SEGMENTS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids}
        ranks = {score: n for n, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        symbols = {s: n for n, s in enumerate(dict.fromkeys([*pieces, *"".join(pieces)]))}
        assert len(symbols) < 1 << 20
        #: of two symbols that together are a piece: its rank, and its symbol
        self.rank: dict[int, int] = {}
        self.joined: dict[int, int] = {}
        for piece, score in pieces.items():
            for at in range(1, len(piece)):
                if (left := symbols.get(piece[:at])) is not None and (right := symbols.get(piece[at:])) is not None:
                    self.rank[left << 20 | right] = ranks[score]
                    self.joined[left << 20 | right] = symbols[piece]
        self.symbol = {s: n for s, n in symbols.items() if len(s) == 1}
        self.single = {s for s in pieces if len(s) == 1}
        self.adjacent = {piece[at : at + 2] for piece in pieces for at in range(len(piece) - 1)}
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lines_apart = self.apart and not any("\n" in p for p in pieces)
        self.kept = kept

    def __missing__(self, segment: str) -> int:
        # characters at the end that no piece has in this neighbourhood stay alone
        end, adjacent, alone = len(segment), self.adjacent, 0
        while end > 1 and segment[end - 2 : end] not in adjacent:
            end -= 1
            alone += self.cost(segment[end])
        if alone:
            segment = segment[:end]
            if (n := self.get(segment)) is not None:
                return n + alone
        n = self.merged(segment)
        if len(self) < self.kept and end < 200:
            self[segment] = n
        return n + alone

    def cost(self, character: str) -> int:
        """Tokens of a character that is not merged: itself, or its bytes."""
        return 1 if character in self.single else len(character.encode("utf-8", "surrogatepass"))

    def merged(self, segment: str) -> int:
        """Symbols left of a segment: initial symbols minus merges."""
        n = len(segment)
        single = self.single
        known = single.issuperset(segment)
        count = n if known else sum(map(self.cost, segment))
        if n < 2:
            return count
        rank_of, joined = self.rank.get, self.joined
        symbols = [self.symbol.get(s, -1) for s in segment]
        now = [rank_of(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
        now.append(-1)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if now[i] != rank:
                continue  # one of its symbols has been merged meanwhile
            j = after[i]
            if known:
                count -= 1
            else:
                # an unmerged character without a piece of its own counted its bytes
                count -= self.weight(segment, i, j) + self.weight(segment, j, after[j] if after[j] >= 0 else n) - 1
            symbols[i] = s = joined[symbols[i] << 20 | symbols[j]]
            now[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                now[i] = rank = rank_of(s << 20 | symbols[k], -1)
                if rank >= 0:
                    heappush(heap, rank * n + i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = rank = rank_of(symbols[h] << 20 | s, -1)
                if rank >= 0:
                    heappush(heap, rank * n + h)
        return count

    def weight(self, segment: str, begin: int, end: int) -> int:
        """What the symbol over this range counted before it is merged on."""
        return self.cost(segment[begin]) if end - begin == 1 else 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if not self.apart:
            return self.merged(MARK + text.replace(" ", MARK))
        if self.lines_apart and "  " not in text and text[0] != " " and "\n " not in text:
            # each newline is a token of its own byte; what follows it has no word mark
            parts = f"{MARK}{text.replace(' ', ' ' + MARK)}".replace("\n", " ").split(" ")
            return sum(map(self.__getitem__, parts)) + text.count("\n")
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)))


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_count(text: Column, model_path: str | None = None) -> Column:
    """Tokens of a text column as a long; null and empty texts have none."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_path or default_model())
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    return counted(text)


def with_token_counts(docs: DataFrame, text: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    One narrow pass without a shuffle.  A null text counts as empty: 0 bytes, 0
    tokens, not over the limit.  Texts of any length are counted whole.  Repeated
    rows each keep their row; columns of ``docs`` that bear one of the three names
    are replaced; an empty table gives an empty result.
    """
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")),
            "n_tokens": token_count(F.col(text), model_path),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
