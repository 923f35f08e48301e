from __future__ import annotations

import re

import pytest


def shingles(text: str | None) -> set[tuple[str, ...]]:
    """Five-word shingles by the book."""
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="session")
def shingle_set():
    return shingles


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a frame with columns that operators must not mind."""
    def make(rows, partitions=3):
        extra = [(i, t, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(extra, "doc_id bigint, text string, row string, part int, shard string").repartition(partitions)
    return make
