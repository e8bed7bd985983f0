"""Optional models behind small interfaces, with defaults that need no network and give the same result every time."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 3


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Words hashed to signed dimensions, normalised to length one."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for k, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[k, h % self.size] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


@lru_cache(maxsize=100_000)
def _place(word: str, size: int) -> tuple[int, int]:
    h = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16)
    return h % size, 1 if h // size % 2 else -1


class DigestEmbedder:
    """Words placed by the first four digits of their MD5 digest, which SQL can say too; normalised to length one, a text without words is all zeros."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            for w in text.lower().split():
                at, sign = _place(w, self.size)
                out[k, at] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "embedding") -> DataFrame:
    """df with a normalised vector of each text; null counts as empty."""
    model = embedder or HashEmbedder()

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(model(s.fillna("").tolist())))

    return df.withColumn(name, run(F.col(text)))


def wait_schedule(errors: list[str | None], long_wait: float | None = None, default: float = 30.0, other: float = 5.0) -> list[float]:
    """Seconds to wait after each failed attempt: what a quota error asks for, else a short pause; the last attempt raises, and so does a wait over long_wait."""
    import re

    out = []
    for k, e in enumerate(errors, 1):
        if k >= ATTEMPTS:
            break
        quota = e is not None and ("429" in e or "RESOURCE_EXHAUSTED" in e)
        found = re.search(r"retry in ([0-9.]+)s", e or "", re.I)
        later = re.search(r"retry after ([0-9.]+)s", e or "", re.I)
        s = (float(found[1]) + 2 if found else float(later[1]) if later else default) if quota else other
        if long_wait is not None and s > long_wait:
            raise RuntimeError("LONG_QUOTA_WAIT")
        out.append(s)
    return out


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, long_wait: float | None = None) -> str:
    """The result of call, tried again after the waits of wait_schedule; a wait over long_wait ends it at once."""
    errors: list[str | None] = []
    while True:
        try:
            return call()
        except Exception as e:
            errors.append(str(e))
            if len(errors) >= ATTEMPTS:
                raise
            sleep(wait_schedule(errors, long_wait)[-1])


def extract(chunks: DataFrame, prompt: str, extractor: Extractor, schema: str, long_wait: float | None = None) -> DataFrame:
    """chunks with extraction, parsed by the schema; a text that does not parse stops the job, so that its chunk is not marked as done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "_raw": [with_retries(lambda p=p: extractor(p), long_wait=long_wait) for p in pdf["_prompt"]]})

    raw = chunks.select(F.col("chunk_id").cast("bigint"), F.col(prompt).alias("_prompt")).mapInPandas(run, "chunk_id bigint, _raw string")
    return raw.select("chunk_id", F.from_json("_raw", schema, {"mode": "FAILFAST"}).alias("extraction"))


class EchoGenerator:
    """Answers with the first passage of the prompt, or declines when there is none."""

    def __call__(self, prompt: str) -> str:
        from loreloom.functions.text import UNKNOWN_RESPONSE

        at = prompt.find("PASSAGE:")
        return prompt[at + 8 :].strip().split("\n")[0] if at >= 0 else UNKNOWN_RESPONSE


def generate(df: DataFrame, prompt: str, generator: Generator | None = None, name: str = "answer") -> DataFrame:
    model = generator or EchoGenerator()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: with_retries(lambda: model(p)))

    return df.withColumn(name, run(F.col(prompt)))


def propose(contexts: DataFrame, planner: Generator, by: str = "book_id", context: str = "context", long_wait: float | None = None) -> DataFrame:
    """(by, ord, canonical, aliases, confidence, reason): the merges a model proposes for each context; a text that is no plan stops the job. They count only as far as ``valid_plan`` accepts them."""
    kind = dict(contexts.dtypes)[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({by: pdf[by], "_raw": [with_retries(lambda p=p: planner(p), long_wait=long_wait) for p in pdf["_context"]]})

    raw = contexts.select(by, F.col(context).alias("_context")).mapInPandas(run, f"{by} {kind}, _raw string")
    plan = F.from_json("_raw", "groups array<struct<canonical:string,aliases:array<string>,confidence:string,reason:string>>", {"mode": "FAILFAST"})
    return raw.select(by, F.posexplode(plan["groups"]).alias("ord", "g")).select(by, "ord", "g.*")


class EmptyExtractor:
    """Finds nothing, in a valid form."""

    def __call__(self, prompt: str) -> str:
        return json.dumps({"characters": [], "locations": [], "relationships": [], "events": [], "facts": []})
