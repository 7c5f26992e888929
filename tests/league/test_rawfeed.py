"""Raw JSON by specification: lengths in their spellings, texts that are no JSON."""

import pytest
from pyspark.sql import functions as F

from ringlore.sources import rawfeed


@pytest.mark.parametrize(
    ("text", "cm"),
    [
        ("180", 180), ("180.4 cm", 180), ("1.8 m", 180), ("71 in", 180), ("71\"", 180), ("5' 11\"", 180), ("5’11”", 180), ("5 ft 11 in", 180), ("6 feet", 183), ("5' 11½\"", 182), ("5ft", 152), ("99", None), ("251 cm", None), ("tall", None), ("", None), (None, None),
        ("5' 11\" / 180", None), ("-180", None),
    ],
)
def test_length(spark, text, cm):
    assert spark.createDataFrame([(text,)], "t string").select(rawfeed.length_cm(F.col("t"))).first()[0] == cm


def test_mapped(spark):
    texts = ['{"id":"a","name":"X","physical":{"height":180,"reach":"6 ft"},"stats":{"wins":3.0},"active":"yes"}', "{", None, "[1]", '{"id":1}', '{"id":2,"names":{"full":"Y"},"name":null,"division":{"name":"Heavy"},"stats":{"wins":-1}}']
    rows, problems = rawfeed.mapped(spark.createDataFrame(list(enumerate(texts)), "n int, j string"), "n", "j", rawfeed.FIGHTER)
    assert [(r.n, r.external_id, r.name, r.height_cm, r.reach_cm, r.wins, r.active, r.division) for r in rows.orderBy("n").collect()] == [(0, "a", "X", 180, 183, 3, True, None), (5, "2", "Y", None, None, -1, None, "Heavyweight")]
    assert sorted(((r.n, r.field, r.problem) for r in problems.collect()), key=repr) == [(1, None, "not_json"), (2, None, "not_json"), (3, "external_id", "missing"), (3, "name", "missing"), (4, "name", "missing")]
