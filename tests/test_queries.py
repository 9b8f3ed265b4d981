"""Every registered query of the library against its SQL twin, over the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from docquarry.plans import registry

#: Retrieval paths share one chain of operators; of the slow ones those that end it run here, the rest in the driver's check.
ENDS = {"bm25_topk", "hybrid_topk", "two_stage", "diversity_fusion", "recall_mrr"}
CHAIN = {n for n, f in registry.queries().items() if f.__module__.endswith("retrieval") or n in ("coverage", "recall_mrr", "token_f1")}
LIGHT = {"vector_topk", "vector_topk_filtered", "expand_queries", "intent_keywords", "intent_rules", "route_counts", "strategy", "query_entities", "strip_entities", "light_mode", "query_slots", "doc_search", "dedup_queries"}
NAMES = sorted(set(registry.oracle_sql()) - (CHAIN - ENDS - LIGHT))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, db, name):
    frame = registry.queries()[name](spark, sf_dir)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    rows = lambda got, names: Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in got)
    assert rows(map(tuple, frame.collect()), frame.columns) == rows(want.fetchall(), want.columns)


def test_table_boost_is_the_whole_method(spark, sf_dir, db):
    """Both lists as SQL has them; tables that no plain search finds come in, and queries that ask for no figure keep their lists."""
    test_same_as_sql(spark, sf_dir, db, "table_boost")
    plain = {(r.query_id, r.point_id): r.score for r in registry.queries()["bm25_topk"](spark, sf_dir).collect()}
    rows = registry.queries()["table_boost"](spark, sf_dir).collect()
    lexical = {(r.query_id, r.point_id): r.score for r in rows if r.list == 2}
    asking = {q for q, t in db.sql("SELECT item_id, text FROM benchmark").fetchall() if any(w in t for w in ("the", "les", "los", "and ", "et ", "y "))}
    raised = {q for q, p in plain if lexical[q, p] != plain[q, p]}
    assert lexical.keys() == plain.keys() and raised <= asking and asking < {r.query_id for r in rows}
    found = {(r.query_id, r.point_id) for r in rows if r.list == 1}
    vectors = {(r.query_id, r.point_id) for r in registry.queries()["rrf"](spark, sf_dir).collect() if r.vector_rank is not None}
    assert found - vectors and {q for q, _ in found - vectors} <= asking


def test_every_query_returns_rows(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_point_has_them_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(registry.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names
