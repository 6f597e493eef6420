"""Registered queries of the operators against their SQL, and what each returns."""

from __future__ import annotations

import pytest

from cadenza.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import connect, difference

COLUMNS = {
    "op3_nearest": ["query_id", "rank", "vec_id", "score"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken", "copies"],
    "op6_html_text": ["page_id", "url", "text", "n_chars"],
    "op7_lang_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op12_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "learned_score"],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_columns_of_the_others(spark):
    assert set(COLUMNS) == set(QUERIES) - set(ORACLES)
    for name, columns in COLUMNS.items():
        assert QUERIES[name](spark, SF).columns == columns
