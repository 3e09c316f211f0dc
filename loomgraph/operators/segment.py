"""Segmentation of words by given merges or pieces. Tokenizers are not trained here; their files are inputs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of a word after all merges in their order; later pieces are marked by ##."""
    parts = [*word, END]
    while len(parts) > 1:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            break
        rank, _ = min(found)
        joined, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank:
                joined.append(parts[i] + parts[i + 1])
                i += 2
            else:
                joined.append(parts[i])
                i += 1
        parts = joined
    parts = [p for p in [*parts[:-1], parts[-1].removesuffix(END)] if p]
    return [p if k == 0 else f"##{p}" for k, p in enumerate(parts)]


def best_pieces(word: str, pieces: dict[str, float], unknown: float = -20.0, longest: int = 6) -> list[str]:
    """The segmentation of the largest summed log probability; single characters that are no piece cost `unknown`. Later pieces are marked by ##."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            score = pieces.get(word[start:end], unknown if end - start == 1 else None)
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start)
    cuts, end = [], len(word)
    while end:
        cuts.append(word[best[end][1] : end])
        end = best[end][1]
    return [p if k == 0 else f"##{p}" for k, p in enumerate(reversed(cuts))]


def segment_words(words: DataFrame, how, column: str = "token") -> DataFrame:
    """(token, pieces) of distinct words by `how(word) -> list`: each word once, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda w: [] if w is None else how(w))

    return words.select(F.col(column).alias("token")).distinct().select("token", cut("token").alias("pieces"))
