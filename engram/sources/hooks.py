"""Replaceable models: embeddings, extraction, planning, reranking, emotions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def embedding_hook(model: Callable[[list[str]], np.ndarray]):
    """A function of text batches as an array column."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(["" if t is None else t for t in texts]), np.float32)))

    return run


def hashed_embedding(dims: int = 64):
    """The offline default: signed hashed words, unit length. The same words always give the same vector."""
    import zlib

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(out[i])
            out[i] /= n or 1
        return out

    return embedding_hook(model)


def answer_hook(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str, answer: str = "answer") -> DataFrame:
    """rows with a model's answer to a prompt column, a batch at a time; a failure is a null answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                out = model(f[prompt].tolist())
            except Exception:  # noqa: BLE001 - a remote model may fail in any way; the row stays
                out = [None] * len(f)
            yield f.assign(**{answer: out})

    return rows.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, {answer} string")


def reranked(rows: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None, query: str, text: str = "text") -> DataFrame:
    """Scores by a hook on (query, text), a batch at a time; without one, or for batches in which it fails, the rows stay as they are."""
    if scorer is None:
        return rows

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return scorer(q, t)
        except Exception:  # noqa: BLE001 - a remote model may fail in any way
            return pd.Series([None] * len(t), dtype="float64")

    return rows.withColumn("score", F.coalesce(run(F.lit(query), F.col(text)), F.col("score")))


def extraction_prompt(text, types: tuple[str, ...], language: str = "en"):
    """The deterministic part of an extraction prompt as a column."""
    return F.concat(F.lit(f"List the events of the passage as a JSON array. event_type is one of: {', '.join(types)}. importance is 1 to 10. Answer in {language}.\n\n"), text)
