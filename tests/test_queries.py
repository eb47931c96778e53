"""Registered queries against DuckDB on the smallest tables: a cross-section here, all of them in the driver's check."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from spanloom.plans.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "q1_7_read_transcripts", "q1_11_read_events_prefix", "q1_28_build_srt", "q2_19_rejected_rows", "q2_49_validate_ratings", "q3_1_temporal_iou", "q3_4_turn_bounds", "q3_13_boundary_reconciliation",
    "q3_24_caption_layout", "q4_17_decide_canonical", "q4_33_path_unique_wins", "q4_41_visual_scorecard", "q5_1_segment_sentences", "q5_7_subtract_intervals", "q5_13_tighten_silence", "q5_22_fuse_boundary",
    "q5_29_scene_windows", "q5_31_critique_windows", "q6_5_bm25_search", "q6_6_vector_retrieve", "q6_23_select_for_validation", "q7_4_freeze_study", "q9_10_streamed_windows", "q10_1_model_hook",
    "q1_5_load_manifest", "q1_17_attach_diarization", "q1_20_check_subtitles", "q1_23_write_once", "q1_34_episode_timeline", "q2_11_shot_plan", "q2_21_times_within_window", "q2_39_full_audit",
    "q3_2_merge_candidates", "q3_30_reconcile_delivery", "q4_7_micro_cer", "q4_43_slice_report", "q4_60_crop_jitter", "q4_61_upper_median", "q5_8_filler_words", "q5_15_continuity_protection", "q5_37_caption_chunks",
    "q5_41_choose_face", "q6_10_vote_candidate_spans", "q6_17_validate_proposals", "q6_21_reconcile_manifest", "q6_22_episode_package", "q6_25_condense_story", "q7_2_stratified_sample", "q8_5_edit_distance", "q9_6_reusable_raw", "q10_9_event_stream",
]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 250


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)
