"""The coherent core against a brute-force fixpoint."""

from types import SimpleNamespace

from ringlore.operators import merging


def brute_core(ids, met):
    core = set(ids)
    while out := {a for a, b in met if a in core and b not in core}:
        core -= out
    return core


def test_core_of_long_and_short_careers(spark):
    """Fighters of up to 122 bouts; 5 is partial and 41 conflicts, so the chain from 1 to 4 and the pair of 12 leave, the rest stay."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (6, 7), (7, 8), (9, 11), (12, 41)]
    met = pairs + [(b, a) for a, b in pairs]
    ids = sorted({a for a, _ in met} | {30})
    careers = spark.createDataFrame([(i, 50 if i in (6, 8) else 100 if i in (7, 9, 30) else 3, 20, 2, "male", "BUILDING") for i in ids], "boxer_id long, wins long, losses long, draws long, sex string, division string")
    w = SimpleNamespace(careers=careers, counted=spark.createDataFrame(met, "boxer_id long, opp_id long"))
    complete = {r.boxer_id for r in merging.reconciliation(w).where("verdict = 'complete'").collect()}
    assert complete == set(ids) - {5, 41}
    want = brute_core(complete, met)
    assert want == {6, 7, 8, 9, 11, 30}
    assert {r.boxer_id for r in merging.coherent_core(w).collect()} == want
