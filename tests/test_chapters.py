from pyspark.sql import functions as F

from lectern.operators.chapters import chapters_json, chapters_of, first_of_two, stored_chapters

ITEMS = '[{"title":" ","text":"one"},{"title":"B","text":"  "},{"title":"C","text":"three"}]'


def test_stored_chapters_and_json(spark):
    df = spark.createDataFrame([(1, ITEMS), (2, "[]"), (3, None), (4, "no json")], "id int, doc string")
    got = {r.id: [tuple(c) for c in r.c] for r in df.select("id", stored_chapters(F.col("doc")).alias("c")).collect()}
    assert got == {1: [("第 1 章", "one"), ("C", "three")], 2: [], 3: [], 4: []}
    again = df.select("id", stored_chapters(chapters_json(stored_chapters(F.col("doc")))).alias("c")).collect()
    assert {r.id: [tuple(c) for c in r.c] for r in again} == got


def test_first_of_two_over_the_three_candidates(spark):
    """Stored chapters, else those of the source file, else the divided text."""
    two, one = '[{"title":"A","text":"a"},{"title":"B","text":"b"}]', '[{"title":"A","text":"a"}]'
    rows = [(1, two, one, "x"), (2, one, two, "x"), (3, one, one, "x"), (4, None, None, "x")]
    df = spark.createDataFrame(rows, "id int, stored string, source string, full_text string")
    c = first_of_two(stored_chapters(F.col("stored")), stored_chapters(F.col("source")), chapters_of(F.col("full_text")))
    got = {r.id: [x.text for x in r.c] for r in df.select("id", c.alias("c")).collect()}
    assert got == {1: ["a", "b"], 2: ["a", "b"], 3: ["x"], 4: ["x"]}
