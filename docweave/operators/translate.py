"""Translation of blocks through a provider, in batches, with failures kept apart."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 10


class Translator(Protocol):
    name: str

    def translate(self, texts: list[str], source: str, target: str) -> list[str]: ...


class Identity:
    """Stands in where no translator is: gives texts back."""

    name = "noop"

    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return list(texts)


class TranslationError(RuntimeError):
    def __init__(self, message: str, provider: str):
        super().__init__(message)
        self.provider = provider


REGISTRY: dict[str, type] = {"noop": Identity}


def provider(name: str) -> Translator:
    return REGISTRY.get(name, Identity)()


def translate_blocks(blocks: DataFrame, name: str, source: str, target: str, text: str = "original_text") -> DataFrame:
    """blocks with translated_text and failed. A batch that fails is tried text by text; a
    text that fails keeps the original and counts as failed."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = provider(name)
        for pdf in it:
            out, failed = [], []
            texts = pdf[text].fillna("").tolist()
            for a in range(0, len(texts), BATCH):
                part = texts[a : a + BATCH]
                try:
                    got = own.translate(part, source, target)
                    if len(got) != len(part):
                        raise TranslationError("incomplete answer", own.name)
                    out += got
                    failed += [False] * len(part)
                except Exception:  # noqa: BLE001  any provider error falls back to single texts
                    for t in part:
                        try:
                            out += own.translate([t], source, target)
                            failed.append(False)
                        except Exception:  # noqa: BLE001
                            out.append(t)
                            failed.append(True)
            yield pdf.assign(translated_text=out, failed=failed)

    keep = [c for c in blocks.columns if c not in ("translated_text", "failed")]
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return blocks.select(*keep).mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "translated_text string", "failed boolean"]))


def qa_sample(block_id: str, share: float = 0.2):
    """A reproducible sample of blocks: by the hash of their id."""
    return F.pmod(F.xxhash64(block_id), F.lit(1000)) < int(share * 1000)
