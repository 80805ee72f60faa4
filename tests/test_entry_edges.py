"""Rows at the edges of library operators that the registered queries do not reach."""

import pytest

from textpulse.sources import comments, tables


def test_a_topic_is_read_whole_unless_told():
    options = comments.topic_options()
    assert options["startingOffsets"] == "earliest" and options["endingOffsets"] == "latest"
    assert "kafka.group.id" not in options and comments.topic_options(group="g")["kafka.group.id"] == "g"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["2 1", "a 0.5", "7 1"], {"a": [0.5], "7": [1.0]}),
        (["a 0.5", "b 1"], {"a": [0.5], "b": [1.0]}),
    ],
)
def test_word_vectors_of_one_dimension(spark, tmp_path, lines, want):
    path = tmp_path / "v.txt"
    path.write_text("\n".join(lines) + "\n")
    assert {r["word"]: r["vector"] for r in tables.read_word_vectors(spark, str(path), 1).collect()} == want


def test_a_line_that_is_no_vector_fails(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("2 3\na 1 2 3\nb 9\n")
    with pytest.raises(Exception, match="not 3 dimensions"):
        tables.read_word_vectors(spark, str(path), 3).collect()
