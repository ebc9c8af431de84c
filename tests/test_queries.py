"""Registered queries against their SQL twins on the smallest tables.

By default one query per operator family is run; TESSERA_ALL=1 runs them all.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DEFAULT = """p05_membership p08_cast_wide p14_split_path_default p19_bags_in_long_form p20_row_per_positive_label j07_first_match
j09_listed_flag j12_self_lag_join j13_linked_set_distance j14_common_neighbours a04_median a06_mode a07_mode_position a14_group_list
a21_target_encoding a22_field_value_counts a28_log_count_ratio a29_list_moments a39_always_reordered w01_row_number w06_previous_basket
w10_second_highest w13_added_flags w15_percentile_rank w17_cumulative_gain t03_top_columns_per_row t05_keep_frequent t10_transition_table
c02_fallback_chain c08_outlier_to_usual c15_square_code c23_softmax_in_bag x02_comment_rules x08_fold_symbols x10_marked_words
x24_char_gram_text x26_id_sequences x28_spelling_neighbours s02_weighted_share s09_gram_positions s12_tfidf_euclidean s15_text_ratios
s21_nearest_neighbours e07_word_tfidf e09_hashed_bag e15_robust_scaled m06_oversampled m08_bootstrap m31_normalised_gini m32_roc_auc
m36_correlations m41_majority_vote m43_blend_grid m46_submission io07_glob_with_file_name io12_svmlight_lines io13_ffm_lines
st01_running_counts st02_stream_enrichment f05_user_product f09_purchase_pattern f10_markov f12_customer_vectors f15_ad_ranking
f16_demand_prediction f24_clean_comment f25_claim_features""".split()

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("TESSERA_ALL") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(str(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "label" in df.columns
