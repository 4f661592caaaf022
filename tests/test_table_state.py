"""What is kept of a table follows the table: scores, models and logs of a rewritten one are made anew."""

import pyarrow.parquet as pq

from conftest import SF_SMALL
from labelflow.plans import q_active, q_model
from labelflow.sources.tables import table_state

DOCUMENTS = f"{SF_SMALL}/documents.parquet"


def write(folder, table):
    pq.write_table(table, folder / "documents.parquet")


def test_rewritten_table_is_scored_again(spark, tmp_path):
    sf, table = str(tmp_path), pq.read_table(DOCUMENTS)
    write(tmp_path, table)
    before = table_state(spark, sf, "documents")
    assert q_model.scored_all(spark, sf).count() == table.num_rows
    model = q_model.letter_model(spark, sf)
    assert q_model.letter_model(spark, sf) is model and table_state(spark, sf, "documents") == before
    write(tmp_path, table.slice(0, table.num_rows // 2))
    assert table_state(spark, sf, "documents") != before
    assert q_model.letter_model(spark, sf) is not model
    assert q_model.scored_all(spark, sf).count() == table.num_rows // 2
    assert q_active.al_pool(spark, sf).count() == table.num_rows // 2


def test_state_of_a_folder_of_files(spark, tmp_path):
    half = pq.read_table(DOCUMENTS).slice(0, 20)
    (tmp_path / "documents.parquet").mkdir()
    pq.write_table(half, tmp_path / "documents.parquet" / "a.parquet")
    first = table_state(spark, str(tmp_path), "documents")
    pq.write_table(half, tmp_path / "documents.parquet" / "b.parquet")
    assert table_state(spark, str(tmp_path), "documents") != first
