"""Queries that read the parsed notes several times parse each note once."""

from collections.abc import Iterator

import pyarrow as pa
import pytest

from conftest import SMALL
from lodestar.plans import q_vault
from lodestar.registry import QUERIES
from lodestar.sources import vault


@pytest.mark.parametrize("name", ["resolve_name", "graph_view", "broken_links", "identity_sections", "identity_topic", "context_lexical", "context_pack"])
def test_parsed_once(spark, monkeypatch, name):
    n, real = spark.sparkContext.accumulator(0), vault.parsed

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(q_vault.vault, "parsed", lambda raw: real(raw.mapInArrow(counted, raw.schema)))
    QUERIES[name](spark, SMALL).collect()
    assert n.value == spark.read.parquet(f"{SMALL}/documents.parquet").count()
