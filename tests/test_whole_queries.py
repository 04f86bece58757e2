"""Queries without SQL take all reads: phased reads are counted, first-fit colours found by brute force."""
import pytest

import __spark_entry__ as entry
from test_queries import DATA, pytestmark  # noqa: F401

@pytest.fixture(scope="module")
def every(spark):
    from strandset.sources.driver_tables import reads

    return [tuple(x) for x in reads(spark, DATA).where("s < e").select("contig", "read_id", "s", "e").collect()]


@pytest.mark.parametrize("name", ["hmm_phase", "hmm_posteriors"])
def test_every_read_is_phased(spark, every, name):
    got = entry.queries()[name](spark, DATA).collect()
    assert sorted((x.contig, x.read_id) for x in got) == sorted({x[:2] for x in every})


def test_coverage_cap_takes_all_reads(spark, every):
    """Colours by first fit over all reads of a contig, by start and longest first; those of colour 4 and above go."""
    want = {}
    for contig in {x[0] for x in every}:
        ends = []
        for s, e in sorted((x[2:] for x in every if x[0] == contig), key=lambda x: (x[0], -x[1])):
            k = next((i for i, z in enumerate(ends) if z <= s), len(ends))
            ends[k : k + 1] = [e]
            want[contig, s, e] = want.get((contig, s, e), 0) + (k < 4)
    place = {x[:2]: x for x in every}
    got = {}
    for x in entry.queries()["coverage_cap"](spark, DATA).collect():
        c, _, s, e = place[x.contig, x.read_id]
        got[c, s, e] = got.get((c, s, e), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
