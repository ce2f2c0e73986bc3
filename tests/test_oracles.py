"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

from corpusloom import session  # noqa: E402
from corpusloom.operators import recall  # noqa: E402


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok, message


LARGE = [
    "backlinks", "unresolved_links", "stub_mentions", "identity_collisions", "commit_outcomes", "ensure_outcomes",
    "query_vectors", "embedding_stale", "frontmatter_parse", "recall_feedback", "recall_hybrid", "event_day_log",
]


@pytest.mark.parametrize("name", LARGE)
def test_paths_for_large_inputs_match_too(spark, con, sf_dir, name, monkeypatch):
    """The same answers when nothing counts as small: no broadcasts, many scans."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(recall, "QUERIES_PER_SCAN", 15)
    monkeypatch.setattr(recall, "BLOCK_ROWS", 40)
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, message
