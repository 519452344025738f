"""Queries against the SQL that they are compared with."""

import os

import duckdb
import pytest

from weft.plans import catalog

DATA = "/root/testdata/sf0.001"
FAST = (
    "dpn_rules_base", "dpn_rules_push", "dpn_rules_pop", "dpn_rules_spawn", "dpn_symbols", "dpn_rule_counts", "rule_numbering", "transition_table", "can_terminate", "lockset_algebra", "lock_graph_acyclic", "lock_orders", "dep_candidates", "field_map", "status_rollup_conj", "status_rollup_disj", "set_ops", "subset_violations", "backward_slice",
    "rules_of_calls", "rules_of_monitors", "rules_of_blocks", "rules_of_ends_and_starts", "rules_without_actions", "locks_used", "lock_users", "safe_locks", "call_edges",
    "field_accesses", "field_objects", "shared_objects", "access_annotations", "program_points", "method_entry_set", "exception_kinds", "flow_graph", "call_graph_lines",
    "isolation_product", "mnfs_conflict_pair", "mnfs_facts", "mnfs_graph", "trim_base", "scc_sizes", "map_lattice", "genkill_composition",
    "flow_cycles", "unique_sites", "result_tree", "result_print", "enabled_rules", "network_step",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    # whole numbers and truth values in one writing
    plain = lambda row: str(tuple(int(x) if isinstance(x, bool) else x for x in row))
    got = sorted(plain(r) for r in df.select(*columns).collect())
    cursor = duck.execute(catalog.ORACLES[name])
    places = [[x[0] for x in cursor.description].index(c) for c in columns]
    assert got == sorted(plain(r[i] for i in places) for r in cursor.fetchall())
