"""Lines of an index whose postings have many positions."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers


@pytest.mark.parametrize("n", [1_900, 60_000])
def test_a_posting_with_many_positions_is_read(spark, tmp_path, n):
    """The executor ended on these, by its stack."""
    positions = F.array_join(F.sequence(F.lit(1), F.lit(n)), ",")
    lines = [F.concat(F.lit(f"word|7:{n}/{n}/2:"), positions, F.lit(";8:1/1/2:5;")), F.concat(F.lit(f"bad|9:{n}/{n}/1:"), positions, F.lit(",1234567890;"))]
    spark.range(1).select(F.explode(F.array(*lines)).alias("line")).write.text(str(tmp_path / "lines"))
    rows, bad = readers.read_index_lines(spark, str(tmp_path / "lines"))
    assert sorted((r.term, r.doc_id, r.tf, len(set(r.positions))) for r in rows.collect()) == [("word", 7, n, n), ("word", 8, 1, 1)]
    assert [r.problem for r in bad.collect()] == ["bad posting"]
