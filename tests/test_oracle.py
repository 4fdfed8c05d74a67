"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or more of each family; all of them with ORACLE_ALL=1.
CHOSEN = """a1_degrees a2_metrics a3_panoramic a4_community_stats a12_trust a15_co_change a17_runtime_heat a18_velocity a20_affinity f5_search_literal f6_search_ranking
f9_scan g1_pagerank g2_wavefront g6_causal g12_spectral_pulses g14_impact g15_causal_chains g36_epidemic g42_refactor_plan g46_decay g48_plasticity g51_validate_plan
j4_module_paths j6_cross_domain j9_ghost_edges j13_stack_frames j15_pattern_match j16_document_bindings j17_snapshot_diff s16_blocks s16_entities u1_graph_merge u2_drift w1_tremor w6_churn
x2_find_seeds x5_trigram_tfidf r6_trust_stream s1_code_tree s4_extracted_nodes s5_extracted_edges s6_languages s9_notes s11_bibtex s12_crossref s13_jats s14_patents s15_rfc s18_cargo s19_snapshots s20_spans
k5_persist k8_artifacts g20_communities g22_spectral_gap g24_equivalents g27_standing_wave g30_sympathetic g32_keystones g34_synergy g41_twin_pairs g47_temporal_report g58_antibody_extraction f14_lock_roots f16_guards
x4_seek x8_semantic_query t2_query_fast x10_paths r1_auto_ingest r5_observation_ring s6_methods s6_code_scopes_sql s7_strip_comments s11_bibtex_source s1_tree_stream s20_attributes r3_burst_timers
j14_contained_names g57_separate_parts g20_louvain x1_tokens u8_pattern_similarity g68_external_references w8_trace_depth""".split()


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def one(v):
        if isinstance(v, float) and not isinstance(v, bool):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("ORACLE_ALL") else CHOSEN)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == norm(con.fetchall(), cols)
